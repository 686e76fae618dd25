"""Order Min Hash fingerprints, sensitive to edit distance.

A text's k-mers (``KMER_WORDS`` consecutive words; a shorter text is one
k-mer) are numbered by occurrence, so the second "a b" differs from the
first.  Every numbered k-mer has a hash; its hash names one of ``SKETCHES``
sketches and one of the sketch's ``TUPLE`` cells, and each cell keeps its
minimal k-mer and where in the text it stands.  A sketch hashes its cells'
k-mers in the order in which they stand: moving passages about keeps the
k-mers but changes their order, and so the sketches.

A text of few k-mers leaves cells empty, and a sketch of one k-mer has no
order.  With ``refill`` (as ``fingerprints`` does) the cells form a ring and
a sketch goes on from its first cell until it has ``TUPLE`` filled ones, so
that every sketch keeps an order; only a text of fewer k-mers has fewer.
Sketches whose own cells are all filled are the same either way.

Everything is DataFrame functions.  Texts are dealt once, by ranges of
doc_id, so that a document's successor lies in its own bucket (the first
document of a bucket is also sent to the bucket before); numbering and cells
need no other shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchyard.llm.common import WORD_GAP, shuffle_partitions, uniform, written

KMER_WORDS, SKETCHES, TUPLE = 2, 64, 2
#: Bits of a position inside a cell's packed value (the rest is the k-mer's hash).
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1
_FIRST = -(1 << 63)
#: Characters of text for each task; range buckets for each task; sampled ids for each bucket.
TASK_CHARS, BUCKETS_PER_TASK, IDS_PER_BUCKET = 4_000_000, 4, 20
_SPACES = " \t\n\x0b\x0c\r"


def with_range(df: DataFrame, column: str, bounds: list[int], name: str) -> DataFrame:
    """``name``: how many of the ascending ``bounds`` (without the first) lie at or
    below ``column``, by a binary search."""
    table = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    # the value travels in the accumulator: Spark loses a column that a lambda captures in a grouping key
    def move(acc, step):
        ahead = acc["at"] + step
        at = F.when((ahead < len(bounds)) & (F.get(table, ahead) <= acc["x"]), ahead).otherwise(acc["at"])
        return F.struct(at.alias("at"), acc["x"].alias("x"))

    start = F.struct(F.lit(0).alias("at"), F.col(column).alias("x"))
    return df.withColumn(name, F.aggregate(F.array(*[F.lit(x) for x in steps]), start, move, lambda acc: acc["at"]))


def range_bounds(df: DataFrame, column: str, buckets: int, rows: int) -> list[int]:
    """Lowest values of about ``buckets`` ranges with as many rows each; every range holds its bound."""
    lowest = df.agg(F.min(column)).first()[0]
    if lowest is None:
        return [0]
    share = min(1.0, buckets * IDS_PER_BUCKET / max(1, rows))
    ids = sorted({r[0] for r in df.where(uniform(column, seed=5) < share).select(column).collect()})
    picked = ids[::max(1, len(ids) // buckets)]
    return sorted({lowest, *picked})


def kmers(words: str, k: int) -> Column:
    """Hashes of the k-mers of an array of words, in order; one for fewer words."""
    gram = F.transform(words, lambda w: F.xxhash64(w))
    for i in range(1, k):
        gram = F.zip_with(gram, F.slice(words, F.lit(i + 1), F.size(words)), lambda g, w: F.xxhash64(g, w))
    return F.slice(gram, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))


def _halves(hex_: Column) -> list[Column]:
    """Four longs of 64 hex digits."""
    part = [F.conv(F.substring(hex_, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    return [F.shiftleft(part[2 * i], 32).bitwiseOR(part[2 * i + 1]) for i in range(4)]


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among those that either text has; 1 if neither has any."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), 0).when(x.eqNullSafe(y), 1).otherwise(-1))
    same, differ = F.size(F.filter(pairs, lambda x: x == 1)), F.size(F.filter(pairs, lambda x: x == -1))
    return F.when(same + differ == 0, F.lit(1.0)).otherwise(same / (same + differ))


def as_text(sketch: Column) -> Column:
    """Eight hex digits for each sketch, dashes for one that the text has not."""
    return F.array_join(F.transform(sketch, lambda x: F.coalesce(
        F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit("-" * 8))), "")


def _with_next(df: DataFrame, buckets: int, first: Column, order: list[str], value: str, out: str, tasks: int) -> DataFrame:
    """``out``: the ``value`` of the next row in (b, order); after the last comes the first.

    Rows where ``first`` holds open their bucket; they go to the bucket before as well.
    """
    here = F.struct(F.col("b").alias("b"), F.lit(0).alias("_ghost"))
    there = F.struct(F.pmod(F.col("b") - 1, F.lit(buckets)).alias("b"), F.lit(1).alias("_ghost"))
    dealt = (df.withColumn("_to", F.explode_outer(F.when(first, F.array(here, there)).otherwise(F.array(here))))
             .select("_to.*", *[c for c in df.columns if c != "b"]).repartition(tasks, "b"))
    by = Window.partitionBy("b").orderBy("_ghost", *order)
    return dealt.withColumns({out: F.lead(value).over(by), "rn": F.row_number().over(by)}).where("_ghost = 0").drop("_ghost")


def _refilled(held: str, sketches: int, size: int) -> Column:
    """Sketches of a text from ``held``, its filled cells (cell, v) in ascending order."""
    cell, m = F.col(held), F.size(held)

    # filled cell j opens the sketches whose first cell lies after the filled cell before it
    def opened(j):
        run = F.transform(F.sequence(F.lit(0), F.least(m, F.lit(size)) - 1), lambda t: F.get(cell, F.pmod(j + t, m))["v"])
        last = F.floor(F.get(cell, j)["cell"] / size)
        before = F.when(j == 0, F.lit(-1)).otherwise(F.floor(F.get(cell, j - 1)["cell"] / size))
        return F.struct(_tuple_hash(run).alias("t"), (last - before).cast("int").alias("n"))

    def repeated(x):
        return F.array_repeat(x["t"], x["n"])

    own = F.flatten(F.transform(F.transform(F.sequence(F.lit(0), m - 1), opened), repeated))
    first = F.flatten(F.transform(F.transform(F.sequence(F.lit(0), F.lit(0)), opened), lambda x: F.array_repeat(x["t"], F.lit(sketches))))
    return F.when(m > 0, F.slice(F.concat(own, first), F.lit(1), F.lit(sketches))).otherwise(
        F.array_repeat(F.lit(None).cast("int"), F.lit(sketches)))


def _tuple_hash(cells: Column) -> Column:
    """Low 32 bits, as a signed number, of the hash of the cells' k-mers in the order of their places."""
    in_order = F.sort_array(F.transform(cells, lambda v: F.struct(v.bitwiseAND(F.lit(_PLACE)).alias("p"), F.shiftright(v, _PLACE_BITS).alias("h"))))
    return F.shiftright(F.shiftleft(F.xxhash64(F.transform(in_order, lambda v: v["h"])), 32), 32).cast("int")


def order_min_hash(docs: DataFrame, k: int = KMER_WORDS, sketches: int = SKETCHES, size: int = TUPLE, refill: bool = False) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch) for every row of ``docs``.

    Sketches are arrays of ``sketches`` integers, null where the text has no
    k-mer for it (with ``refill``: no k-mer at all).  The edited text is the text whose last quarter gives way to
    the beginning of the next document's.  Rows are in order of doc_id (nulls
    first), rows of one id in order of a hash of their text; null text is empty.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"_o": F.coalesce("doc_id", F.lit(_FIRST)), "_th": F.xxhash64("text")})
    rows, chars = base.agg(F.count("*"), F.sum(F.length("text"))).first()
    tasks = max(shuffle_partitions(spark), -(-(chars or 0) // TASK_CHARS))
    bounds = range_bounds(base, "_o", tasks * BUCKETS_PER_TASK, rows)
    ranged = with_range(base, "_o", bounds, "b")
    # one row of three numbers for each bucket, as many as len(bounds)
    opening = ranged.groupBy("b").agg(F.min(F.struct("_o", "_th")).alias("_f"))
    ranged = ranged.join(F.broadcast(opening), "b")
    paired = _with_next(ranged, len(bounds), F.col("_f") == F.struct("_o", "_th"), ["_o", "_th"], "text", "_next", tasks)
    n = F.length("text")
    cut = paired.select("b", "rn", "doc_id", "text", "_next", n.cast("long").alias("n_chars"), F.floor(n / 4).cast("int").alias("_q"))
    edit = cut.select("b", "rn", "doc_id", "text", "n_chars", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("_q")), F.substring("_next", F.lit(1), F.col("_q"))).alias("_edited"))
    hashed = edit.withColumn("_sha", F.sha2("_edited", 256))
    both = hashed.select("b", "rn", "doc_id", "n_chars", "_sha", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("t")))).alias("_v"))
    words = both.select("b", "rn", "doc_id", "n_chars", "_sha", "_v.kind", F.btrim("_v.t", F.lit(_SPACES)).alias("_t")).withColumn(
        "_w", F.when(F.col("_t") != "", F.split("_t", WORD_GAP))).drop("_t")
    x = {f"x{i}": c for i, c in enumerate(_halves(F.col("_sha")))}
    # what belongs to the row travels with its first k-mer only
    grams = words.withColumns(x).select("b", "rn", "doc_id", "n_chars", *x, "kind", kmers("_w", k).alias("_g"))
    spread = grams.select("b", "rn", "doc_id", "n_chars", *x, "kind", F.posexplode_outer("_g").alias("p", "g")).withColumn("p", F.coalesce("p", F.lit(0)))
    lead = (F.col("p") == 0) & (F.col("kind") == 0)
    extra = ["doc_id", "n_chars", *x]
    # the mixed key comes first: it sorts by radix, the other columns make it exact
    keyed = spread.select("b", "rn", "kind", "p", "g", *[F.when(lead, F.col(c)).alias(c) for c in extra],
                          F.xxhash64("g", "rn", "kind").alias("_key"))
    nth = F.row_number().over(Window.partitionBy("_key", "b", "rn", "kind", "g").orderBy("p"))
    numbered = keyed.withColumn("_h", F.when(F.col("g").isNotNull(), F.xxhash64("g", nth)))
    cell = F.pmod(F.col("_h").bitwiseAND(F.lit(_PLACE)), F.lit(sketches * size))
    value = F.shiftleft(F.shiftrightunsigned("_h", _PLACE_BITS + 1), _PLACE_BITS).bitwiseOR(F.least(F.col("p"), F.lit(_PLACE)).cast("long"))
    placed = numbered.select("b", "rn", "kind", *extra, F.floor(cell / size).cast("int").alias("s"), F.pmod(cell, F.lit(size)).alias("_sub"), value.alias("_v"))
    cells = placed.groupBy("b", "rn", "kind", "s").agg(
        *[F.min(F.when(F.col("_sub") == i, F.col("_v"))).alias(f"c{i}") for i in range(size)], *[F.min(c).alias(c) for c in extra])
    if refill:
        filled = F.array(*[F.struct((F.col("s") * size + i).alias("cell"), F.col(f"c{i}").alias("v")) for i in range(size)])
        entry = F.struct(F.col("kind"), F.filter(filled, lambda c: c["v"].isNotNull()).alias("c"))
    else:
        held = F.filter(F.array(*[F.col(f"c{i}") for i in range(size)]), lambda v: v.isNotNull())
        entry = F.struct((F.col("kind") * sketches + F.col("s")).alias("i"), _tuple_hash(held).alias("t"))
    sketch = cells.select("b", "rn", *extra, F.when(F.col("s").isNotNull(), entry).alias("_e"))
    whole = sketch.groupBy("b", "rn").agg(F.collect_list("_e").alias("_l"), *[F.min(c).alias(c) for c in extra])
    if refill:
        def of(kind):
            return F.sort_array(F.flatten(F.transform(F.filter("_l", lambda e: e["kind"] == kind), lambda e: e["c"])))

        whole = whole.withColumns({"_h0": of(0), "_h1": of(1)})
    else:
        whole = whole.withColumn("_m", F.map_from_entries("_l"))

    def part(kind):
        if refill:
            return _refilled(f"_h{kind}", sketches, size)
        return F.transform(F.sequence(F.lit(kind * sketches), F.lit((kind + 1) * sketches - 1)), lambda i: F.try_element_at("_m", i))

    sha = F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in x])
    table = written(whole.select("b", "rn", "doc_id", "n_chars", sha.alias("edited_sha256"),
                                 part(0).alias("sketch"), part(1).alias("edited_sketch")), "sketches")
    out = _with_next(table.withColumnRenamed("rn", "_rn"), len(bounds), F.col("_rn") == 1, ["_rn"], "sketch", "next_sketch", tasks)
    return out.select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch")


def fingerprints(docs: DataFrame, refill: bool = True, **how) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    out = order_min_hash(docs, refill=refill, **how)
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"),
                      as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                      likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                      likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
