"""Tables written into the shared folder leave nothing else behind."""

from pyspark.sql import functions as F

from switchyard.session import cut_lineage


def test_written_frames_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark.range(10).count()
    before = files.getAllFiles().size()
    kept = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept.count() == 7 and files.getAllFiles().size() <= before + 2  # the last count's own
