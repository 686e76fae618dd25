"""Seeded, exact, skew-safe stratified sampling and splitting.

Randomness is an md5 of ``seed:id`` (identical in every engine), ties broken
by id.  Ranking a row inside a class would normally need one sort per class,
and a class may hold a third of all rows.  ``exact_class_rank`` therefore
splits every class into hash buckets (a prefix of the same md5, so bucket
order is hash order), counts the buckets (partial aggregation, tiny output),
turns the counts into per-bucket offsets with a window over the *aggregated*
rows, and ranks rows only inside their (class, bucket) partition.  The rank
is exact and no task sorts more than one bucket.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX_DIGITS = 3  # 4,096 buckets per class; raise for very large classes


def hash_key(id_col: str, seed) -> Column:
    """md5 of ``seed:id`` (seed may be a column, e.g. in repeated splits)."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(s.cast("string"), F.lit(":"), F.col(id_col).cast("string")))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """Equi-join in which null keys (rows without a class) match each other."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def exact_class_rank(df: DataFrame, group_cols: list, id_col: str, seed,
                     hex_digits: int = BUCKET_HEX_DIGITS, rank_col: str = "class_rank") -> DataFrame:
    """1-based rank of each row inside its group in (md5(seed:id), id) order."""
    x = df.withColumn("__h", hash_key(id_col, seed)).withColumn(
        "__b", F.substring("__h", 1, hex_digits))
    counts = x.groupBy(*group_cols, "__b").agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy(*group_cols).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(running), F.lit(0))).drop("__n")
    inner = Window.partitionBy(*group_cols, "__b").orderBy("__h", id_col)
    ranked = x.withColumn("__r", F.row_number().over(inner))
    return (_join_null_safe(ranked, offsets, [*group_cols, "__b"])
            .withColumn(rank_col, F.col("__off") + F.col("__r"))
            .drop("__h", "__b", "__off", "__r"))


def stratified_sample(df: DataFrame, group: str, id_col: str, n: int = 10, seed=42) -> DataFrame:
    """min(group size, n) rows per group.  ``row_number() <= n`` lets the
    optimizer insert a partial per-group limit before the shuffle, so a hot
    group ships at most n rows per task."""
    w = Window.partitionBy(group).orderBy(hash_key(id_col, seed), F.col(id_col))
    return (df.withColumn("sample_rank", F.row_number().over(w))
            .where(F.col("sample_rank") <= n))


def _fraction(frac) -> Fraction:
    return Fraction(str(frac)).limit_denominator(1_000_000)


def holdout_sizes(df: DataFrame, group_cols: list, label: str, test_fraction=0.2) -> DataFrame:
    """Per (group, class) test sizes of an exact stratified split.

    n_test = ceil(f * N).  The *train* size is shared out over classes by
    largest remainder of (N - n_test) * n_c / N (ties by class name) and the
    test size per class is the rest, so every class keeps rows on both sides
    when it can.  All arithmetic is on integers of the per-class counts.
    """
    return sizes_of_counts(df.groupBy(*group_cols, label).agg(F.count(F.lit(1)).alias("n_class")), group_cols, label, test_fraction)


def sizes_of_counts(counts: DataFrame, group_cols: list, label: str, test_fraction=0.2, keep: tuple = ()) -> DataFrame:
    """``holdout_sizes`` of counted classes (group columns, class, ``n_class``), with the columns ``keep`` of them."""
    f = _fraction(test_fraction)
    g = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    c = counts.withColumn("n_total", F.sum("n_class").over(g))
    c = c.withColumn("n_test_total", F.expr(
        f"(cast(n_total as decimal(38,0)) * {f.numerator} + {f.denominator - 1}) div {f.denominator}")
        .cast("bigint"))
    c = c.withColumn("n_train_total", F.col("n_total") - F.col("n_test_total"))
    # Exact integer arithmetic (decimal(38,0) avoids long overflow at scale).
    c = c.withColumn("__prod", F.col("n_train_total").cast("decimal(38,0)") * F.col("n_class"))
    c = c.withColumn("base", F.expr("__prod div n_total").cast("bigint")).withColumn(
        "rem", F.expr("__prod % n_total")).drop("__prod")
    c = c.withColumn("short", F.col("n_train_total") - F.sum("base").over(g))
    order = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy(
        F.desc("rem"), F.col(label))
    c = c.withColumn("extra", (F.row_number().over(order) <= F.col("short")).cast("bigint"))
    return c.select(*group_cols, label, "n_class",
                    (F.col("n_class") - F.col("base") - F.col("extra")).alias("n_test"), *keep)


def stratified_holdout(df: DataFrame, label: str, id_col: str, test_fraction=0.2, seed=42,
                       group_cols: list | None = None, seed_col: Column | None = None) -> DataFrame:
    """Exact stratified split; adds ``class_rank`` and ``is_test``.

    The first n_test rows of a class in hash order form its test part."""
    group_cols = list(group_cols or [])
    sizes = holdout_sizes(df, group_cols, label, test_fraction)
    ranked = exact_class_rank(df, group_cols + [label], id_col, seed if seed_col is None else seed_col)
    return (_join_null_safe(ranked, F.broadcast(sizes), group_cols + [label])
            .withColumn("is_test", F.col("class_rank") <= F.col("n_test")))


def holdout_by_threshold(df: DataFrame, label: str, id_col: str, test_fraction=0.2, seed=42, group_cols: list | None = None,
                         seed_col: Column | None = None, hex_digits: int = BUCKET_HEX_DIGITS) -> DataFrame:
    """X2/X3 without ranks: the split of ``stratified_holdout`` as ``is_test`` only.

    A class's test part is what lies at or before one (md5, id).  Counts of hash
    prefixes, added up before their shuffle, tell in which bucket each class's
    last test row lies; the rows of those buckets alone are shuffled and ordered
    to find it.  All other rows are compared with their class's threshold where
    they are, so a class of a third of all rows moves none but one bucket.

    Ids are expected to be unique: rows that share one stay on one side (the
    test part is larger then), and rows without an id count as of one id.  A
    class whose share is nothing has no test row; an empty frame stays empty.
    """
    group_cols = list(group_cols or [])
    keys = [*group_cols, label]
    hashed = df.withColumn("__h", F.coalesce(hash_key(id_col, seed if seed_col is None else seed_col), F.lit("")))
    hashed = hashed.withColumn("__b", F.substring("__h", 1, hex_digits))
    counts = hashed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    # a class's buckets as an array, at most 16 ** hex_digits of them, beside its sizes: counted once
    classes = counts.groupBy(*keys).agg(F.sum("__n").alias("n_class"), F.collect_list(F.struct("__b", "__n")).alias("__held"))
    held = sizes_of_counts(classes, group_cols, label, test_fraction, keep=("__held",)).select(*keys, "n_test", F.inline("__held"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (held.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
            .where("__before < n_test AND n_test <= __before + __n")
            .select(*keys, F.col("__b").alias("__cut"), (F.col("n_test") - F.col("__before")).alias("__need")))
    # one row for each class (and seed), as the sizes of stratified_holdout
    edge = _join_null_safe(hashed.select(*keys, F.col(id_col).alias("__id"), "__h", "__b"), F.broadcast(cuts), keys).where("__b = __cut")
    order = Window.partitionBy(*keys).orderBy("__h", "__id")
    last = (edge.withColumn("__r", F.row_number().over(order)).where("__r = __need")
            .select(*keys, F.col("__h").alias("__last"), F.col("__id").alias("__last_id")))
    same = (F.col("__h") == F.col("__last")) & (F.col("__last_id").isNull() | (F.col(id_col) <= F.col("__last_id")))
    return (_join_null_safe(hashed, F.broadcast(last), keys, "left")
            .withColumn("is_test", F.coalesce((F.col("__h") < F.col("__last")) | same, F.lit(False)))
            .drop("__h", "__b", "__last", "__last_id"))


def check_min_class_size(df: DataFrame, label: str, minimum: int = 2, shown: int = 10) -> None:
    """Raise if a class has fewer than ``minimum`` rows: no split can have it on
    both sides.  The message names at most ``shown`` of them."""
    small = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < minimum).orderBy(label).limit(shown).collect()
    if small:
        raise ValueError(f"classes with fewer than {minimum} rows: " + ", ".join(f"{r[0]} ({r[1]})" for r in small))


def repeated_holdout(df: DataFrame, label: str, id_col: str, seeds, test_fraction=0.2) -> DataFrame:
    """All seeds in one plan.  Rows are multiplied by exploding a fixed
    seed array (no join), then split per (seed, class)."""
    x = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    return stratified_holdout(x, label, id_col, test_fraction, group_cols=["seed"],
                              seed_col=F.col("seed"))


def calibration_folds(split: DataFrame, label: str, n_folds: int = 2) -> DataFrame:
    """Stratified folds of the training part, alternating in hash order
    (the train rank follows from the class rank, no new sort)."""
    train = split.where(~F.col("is_test"))
    return train.withColumn(
        "fold", ((F.col("class_rank") - F.col("n_test") - 1) % n_folds).cast("int"))


def split_leakage(split: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Test rows whose exact text also occurs on the training side (ids are
    disjoint by construction; duplicate texts are not).  Train texts are
    de-duplicated before the lookup, so a hot duplicate text is one key.
    ``key`` names a column that already holds md5(text), so that the split
    need not carry the texts."""
    h = F.col(key) if key else F.md5(F.col(text))
    train = (split.where(~F.col("is_test")).select(h.alias("__t")).distinct()
             .withColumn("__leak", F.lit(True)))
    test = split.where(F.col("is_test")).withColumn("__t", h)
    flagged = test.join(train, "__t", "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(F.col("__leak")).alias("n_test_text_in_train"),
        F.count_distinct(F.when(F.col("__leak"), F.col("__t"))).alias("n_distinct_leaked_texts"),
    ).withColumn("leak_share", F.round(F.try_divide(F.col("n_test_text_in_train").cast("double"),
                                                     F.col("n_test").cast("double")), 6))
