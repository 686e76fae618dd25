"""Readers.  Files are read with explicit schemas; types are applied with
``try_cast``/``try_to_timestamp`` so that bad cells become nulls instead of
failing the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard.functions.columns import null_tokens_to_null, parse_timestamp

# Ticket export layout (21 columns).  Everything is read as text first.
TICKET_COLUMNS = (
    "ticket_id", "created_at", "first_response_at", "resolved_at", "status", "channel",
    "customer_id", "order_id", "product_sku", "category", "priority", "assigned_team",
    "agent_id", "transfers", "csat_score", "refund_amount_inr", "refund_reason_code",
    "replacement_issued", "customer_message", "agent_notes", "source_system",
)
TICKET_SCHEMA = T.StructType([T.StructField(n, T.StringType(), True) for n in TICKET_COLUMNS])

ROSTER_COLUMNS = ("agent_id", "name", "site", "team", "shift", "tier", "from_date", "to_date")
ROSTER_SCHEMA = T.StructType([T.StructField(n, T.StringType(), True) for n in ROSTER_COLUMNS])

# Target types of the typed ticket table.
TICKET_TYPES = {
    "created_at": "timestamp_ntz",
    "first_response_at": "timestamp_ntz",
    "resolved_at": "timestamp_ntz",
    "transfers": "int",
    "csat_score": "int",
    "refund_amount_inr": "decimal(12,2)",
}
ROSTER_TYPES = {"tier": "int", "from_date": "date", "to_date": "date"}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, required: tuple, with_file: bool = False) -> DataFrame:
    """Columns by the names in the header, in whatever order; text only.

    A missing required column is an error, another missing one is null.  Files
    of one glob must agree on their header (``enforceSchema`` is off: Spark
    compares each file's header and fails instead of binding by position).
    multiLine keeps quoted newlines inside a message; such files are not
    splittable, so convert once to parquet for repeated use.
    """
    raw = (spark.read.option("header", True).option("multiLine", True).option("enforceSchema", False)
           .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    lost = [c for c in required if c not in raw.columns]
    if lost:
        raise ValueError(f"{path}: no column {', '.join(lost)}")
    cells = [(F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string")).alias(f.name) for f in schema.fields]
    return raw.select(*cells, *([F.col("_metadata.file_path").alias("source_file")] if with_file else []))


def _whole_number(col):
    """An integer, also when the export wrote it as ``4.0``; null for a fraction."""
    value = col.try_cast("decimal(28,9)")
    return F.when(value == F.floor(value), value.try_cast("int"))


def _typed(raw: DataFrame, name: str, types: dict):
    """(the cell without null tokens, its typed value, what a cell without a value is not)."""
    kind = raw.schema[name].dataType
    text = isinstance(kind, T.StringType)
    cell = null_tokens_to_null(F.col(name)) if text else F.col(name)
    target = types.get(name)
    if target is None:
        return cell, cell, None
    if target == "timestamp_ntz":
        return cell, parse_timestamp(cell, kind), "not a timestamp"
    if target == "int" and text:
        return cell, _whole_number(cell), "not a whole number"
    return cell, cell.try_cast(target), f"not a {target}"


def typed_tickets(raw: DataFrame, types: dict | None = None, rejects: bool = False) -> DataFrame:
    """Null tokens -> null, then typed with try-casts (bad cells -> null).

    With ``rejects`` a column of that name lists each row's bad cells, those that
    hold something else than a null token and got no value, as (cell, value,
    reason); null where there are none.  It comes from the same reading.
    """
    types = TICKET_TYPES if types is None else types
    parts = {name: _typed(raw, name, types) for name in raw.columns if name != "rejects"}
    out = [typed.alias(name) for name, (_, typed, _) in parts.items()]
    if rejects:
        bad = [F.when(cell.isNotNull() & typed.isNull(),
                      F.struct(F.lit(name).alias("cell"), cell.cast("string").alias("value"), F.lit(reason).alias("reason")))
               for name, (cell, typed, reason) in parts.items() if reason]
        none = F.lit(None).cast("array<struct<cell:string,value:string,reason:string>>")
        found = F.filter(F.array(*bad), lambda r: r.isNotNull()) if bad else none
        out.append(F.when(F.size(found) > 0, found).alias("rejects"))
    return raw.select(*out)


def rejected_cells(typed: DataFrame, *keys: str) -> DataFrame:
    """One row for every bad cell of a table typed with ``rejects``: the key
    columns of its row, cell, value, reason.  Rows without one cost no more
    than a look at the column."""
    return typed.where(F.col("rejects").isNotNull()).select(*keys, F.inline("rejects"))


def convert_ticket_csv(spark: SparkSession, path_glob: str, out: str, types: dict | None = None) -> DataFrame:
    """The export as a columnar table under ``out``, written in one reading of its
    files: typed columns, ``source_file``, ``rejects``, partitioned by the month
    of creation (``created_month``; null where that cell is bad).

    Quoted newlines keep a CSV file in one task; later readers split the table
    and prune its months.  Spark does not know a row's line in such a file, so
    a bad cell is named by file and ticket.
    """
    raw = _read_csv(spark, path_glob, TICKET_SCHEMA, ("ticket_id", "created_at"), with_file=True)
    table = typed_tickets(raw, types, rejects=True).withColumn("created_month", F.date_format("created_at", "yyyy-MM"))
    # rebalanced by month: right-sized files, a hot month split over tasks
    table.hint("rebalance", "created_month").write.mode("overwrite").partitionBy("created_month").parquet(out)
    return spark.read.parquet(out)


def read_ticket_csv(spark: SparkSession, path_glob: str) -> DataFrame:
    """All files matching the glob (not an arbitrary first one)."""
    return typed_tickets(_read_csv(spark, path_glob, TICKET_SCHEMA, ("ticket_id", "created_at")))


def read_roster_csv(spark: SparkSession, path_glob: str) -> DataFrame:
    raw = _read_csv(spark, path_glob, ROSTER_SCHEMA, ("agent_id", "team"))
    return typed_tickets(raw, ROSTER_TYPES)


AUDIT_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.StringType(), True),
    T.StructField("tag", T.StringType(), True),
    T.StructField("manual_category", T.StringType(), True),
])


def _holds_csv(fs, folder) -> bool:
    """Whether a folder's files are CSV parts, as Spark writes them."""
    names = [entry.getPath().getName() for entry in fs.listStatus(folder)]
    return any(n.endswith((".csv", ".csv.gz")) for n in names)


def read_audit(spark: SparkSession, path: str | None) -> DataFrame:
    """The audit set; an empty frame with the same schema when it is absent.

    The path's own file system says whether it is there; any other trouble with
    that file system is raised, as audited rows would leak into training.
    """
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            if path.endswith(".parquet") or fs.getFileStatus(at).isDirectory() and not _holds_csv(fs, at):
                return spark.read.parquet(path)
            return _read_csv(spark, path, AUDIT_SCHEMA, ("ticket_id",))
    return spark.createDataFrame([], AUDIT_SCHEMA)
