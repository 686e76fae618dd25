"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.session import scratch_path

#: Words are runs of anything but space and the five ASCII control spaces.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``rows`` rows: whole
    texts make Spark's default of 10,000 rows tens of megabytes for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    return scratch_path(spark, f"{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage
    ends here, and a lost executor costs a file read, not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null id: null)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n


def uniform(*cols: str, seed: int = 1) -> Column:
    """A fixed pseudo-random number in [0, 1) for each value of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` whose left rows of one key are dealt over ``salts``
    tasks by ``spread``; ``right`` has one row a key and is repeated ``salts`` times."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def split_words(text: str | None) -> list[bytes]:
    """``bytes.split`` cuts at exactly the six bytes 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batches, rows: int = 512):
    """Arrow batches cut to at most ``rows`` rows, so that few texts are Python objects at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    m = _LETTER.search(text)
    while m and not m[0].isalpha():  # \w also holds a few letter-like numbers
        m = _LETTER.search(text, m.end())
    return m is not None
