"""Join helpers: many-to-one, as-of and fallback lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_many_to_one(fact: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Left many-to-one lookup.  The caller checks that the dimension's keys are
    unique (``quality.duplicate_keys``): a silent fan-out would double count.
    Whether the dimension is broadcast is decided by its bytes
    (``spark.sql.autoBroadcastJoinThreshold``, AQE)."""
    return fact.join(dim, on=key, how=how)


def asof_lookup(fact: DataFrame, dim: DataFrame, key: str, ts: Column,
                from_col: str = "from_date", to_col: str = "to_date") -> DataFrame:
    """Range (as-of) lookup: the dimension row whose [from, to) validity
    interval holds the fact timestamp.  Open ends are null.  An equi-join on
    the key plus a range residual: the hash join handles it, no cross product.
    """
    d = dim.withColumnRenamed(key, "__k")
    cond = (F.col(key) == F.col("__k")) & (
        F.col(from_col).isNull() | (ts >= F.col(from_col))) & (
        F.col(to_col).isNull() | (ts < F.col(to_col)))
    return fact.join(d, cond, "left").drop("__k", from_col, to_col)


def fallback_lookup(fact: DataFrame, dim: DataFrame, primary: str, fallback_keys: list,
                    fallback_map: DataFrame, dim_key: str, mapped: str = "fallback_key") -> DataFrame:
    """Two-step lookup: ``primary`` when present, else the key found through
    ``fallback_map`` on ``fallback_keys``; then one join to the dimension.
    Only rows without a primary key are shuffled to the map."""
    direct = fact.where(F.col(primary).isNotNull()).withColumn("lookup_key", F.col(primary)).withColumn(
        "match_path", F.lit("primary"))
    mapped_rows = (fact.where(F.col(primary).isNull())
                   .join(fallback_map.select(*fallback_keys, mapped), on=fallback_keys, how="left")
                   .withColumn("lookup_key", F.col(mapped)).drop(mapped)
                   .withColumn("match_path", F.when(F.col("lookup_key").isNotNull(), F.lit("fallback"))
                               .otherwise(F.lit("unmatched"))))
    return direct.unionByName(mapped_rows).join(dim.withColumnRenamed(dim_key, "lookup_key"), on="lookup_key", how="left")
