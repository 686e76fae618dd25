"""SimHash near-duplicate components through vantage-point trees.

``fingerprints`` turns every whole text into a 64-bit SimHash of its word
shingles.  ``components`` links fingerprints that differ in at most
``max_bits`` bits and returns the connected components.

Two fingerprints within four bits agree, in one of their four 16-bit
quarters, up to ``max_bits // 4`` bits.  Each quarter has a vantage-point
tree over the Hamming distance of that quarter: a node holds a vantage point
and a radius, a fingerprint's home is the side it lies on, and it is also
sent as a query to the other side when the triangle bound cannot exclude a
partner there (|d - radius| within the search radius).  The upper levels of
the tree, fitted on a bounded sample of distinct fingerprints, deal the
fingerprints out to shards; every shard goes on splitting on its own (in the
quarter, then over all 64 bits) and compares what is left exactly.  The
bounds never exclude a true partner, so the pairs are exact whatever the
sample was.

Equal fingerprints are merged before any search, so a group of exact copies
costs one row.  A shard reports a spanning forest of its links, not all its
pairs; components are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from switchyard.llm.common import salted_join, short_batches, slices, uniform, written

SHINGLE_WORDS = 4
MAX_BITS = 4
QUARTERS = 4
#: Expected size of the sample that fits the routing trees (512 KB on the driver).
ROUTING_SAMPLE = 65536
#: Distinct fingerprints a shard should own; sets the depth of the routing trees.
#: A level sends about 37 % of the fingerprints to both sides, so a shard is as
#: large as one task searches in seconds (2 MB of them) and the levels are few.
SHARD_TARGET = 1 << 18
LEAF = 48
_SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 16


def simhash(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text (A-Z lower-cased, words by ASCII space)."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, n, _BLOCK):
        a, b = starts[lo:min(n, lo + _BLOCK)].tolist(), ends[lo + k - 1:min(n, lo + _BLOCK) + k - 1].tolist()
        raw = b"".join([digest(joined[x:y], _SEED) for x, y in zip(a, b)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the 64 bits as a signed long.

    Null or wordless text: 0.  Rows with a null doc_id keep it.
    """
    def run(batches):
        for b in slices(batches):
            fp = np.fromiter((simhash(t, k) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def with_fingerprint(rows: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """``rows`` with the column fp of their text."""
    def run(batches):
        for b in slices(batches):
            fp = np.fromiter((simhash(t, k) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield b.append_column("fp", pa.array(fp.view(np.int64)))

    return short_batches(rows).mapInArrow(run, StructType([*rows.schema.fields, StructField("fp", LongType())]))


# ------------------------------------------------------------ vantage-point trees
def _distance(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v).astype(np.int16)


def _masks() -> list[np.uint64]:
    width = 64 // QUARTERS
    return [np.uint64(((1 << width) - 1) << (width * q)) for q in range(QUARTERS)]


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _vantage(points: np.ndarray, mask: np.uint64):
    """(vantage point, radius) that splits ``points`` by distance under ``mask``,
    or None when they are all alike there."""
    masked = points & mask
    v = masked[len(masked) // 2]
    d = _distance(masked, v)
    if not d.any():
        return None
    mu = int(np.median(d))
    if mu >= d.max():
        mu = int(d.max()) - 1
    return v, mu


def routing_tree(sample: np.ndarray, mask: np.uint64, depth: int):
    """Upper levels as nested (vantage, radius, inside, outside); a leaf is None."""
    node = _vantage(sample, mask) if depth and len(sample) > 1 else None
    if node is None:
        return None
    v, mu = node
    inside = _distance(sample & mask, v) <= mu
    return v, mu, routing_tree(sample[inside], mask, depth - 1), routing_tree(sample[~inside], mask, depth - 1)


def route(tree, points: np.ndarray, mask: np.uint64, radius: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(path, indexes, is_home) for every shard that the points go to."""
    out = []

    def down(node, path, idx, home):
        if not len(idx):
            return
        if node is None:
            out.append((path, idx, home))
            return
        v, mu, a, b = node
        d = _distance(points[idx] & mask, v)
        keep = d - radius <= mu
        down(a, path + "0", idx[keep], home[keep] & (d[keep] <= mu))
        keep = d + radius > mu
        down(b, path + "1", idx[keep], home[keep] & (d[keep] > mu))

    down(tree, "", np.arange(len(points)), np.ones(len(points), bool))
    return out


class Forest:
    """Union-find over positions, with vectorised root look-ups."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while True:
            up = p[r]
            if np.array_equal(up, r):
                break
            r = up
        p[x] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite a[i] with b[i]; the smaller position becomes the root."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            todo = ra != rb
            if not todo.any():
                return
            a, b, lo, hi = a[todo], b[todo], np.minimum(ra, rb)[todo], np.maximum(ra, rb)[todo]
            np.minimum.at(self.parent, hi, lo)


def shard_links(points: np.ndarray, home: np.ndarray, mask: np.uint64, radius: int, max_bits: int) -> Forest:
    """Forest over ``points``: links every home with every point within ``max_bits``."""
    forest = Forest(len(points))

    def compare(h, q):
        step = max(1, (1 << 20) // max(1, len(h)))
        for lo in range(0, len(q), step):
            part = q[lo:lo + step]
            i, j = np.nonzero(np.bitwise_count(points[h][:, None] ^ points[part][None, :]) <= max_bits)
            if len(i):
                forest.link(h[i], part[j])

    todo = [(np.flatnonzero(home), np.arange(len(points)), mask, radius)]
    while todo:
        h, q, m, r = todo.pop()
        if not len(h) or not len(q):
            continue
        node = _vantage(points[h], m) if len(h) > LEAF else None
        if node is not None:
            v, mu = node
            dh, dq = _distance(points[h] & m, v), _distance(points[q] & m, v)
            todo.append((h[dh <= mu], q[dq - r <= mu], m, r))
            todo.append((h[dh > mu], q[dq + r > mu], m, r))
        elif len(h) > LEAF and m != _ALL:  # alike in the quarter: go on over all bits
            todo.append((h, q, _ALL, max_bits))
        else:
            compare(h, q)
    return forest


def links(reps: DataFrame, max_bits: int = MAX_BITS, shard_target: int = SHARD_TARGET,
          routing_sample: int = ROUTING_SAMPLE) -> DataFrame:
    """(a, b): a spanning forest of the links between the distinct ``fp`` of ``reps``."""
    spark = reps.sparkSession
    n = reps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_target))))
    drawn = reps.where(uniform("fp") < min(1.0, routing_sample / max(1, n))).select("fp").collect() if depth else []
    sample = np.array([r[0] for r in drawn], np.int64).view(np.uint64)
    radius, masks = max_bits // QUARTERS, _masks()
    trees = [routing_tree(sample, m, depth) for m in masks]

    def deal(batches):
        for b in batches:
            pts = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for q, (tree, mask) in enumerate(zip(trees, masks)):
                went = route(tree, pts, mask, radius)
                shard = [np.full(len(idx), int(f"1{path}", 2) * QUARTERS + q) for path, idx, _ in went]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shard)), pa.array(pts[np.concatenate([w[1] for w in went])].view(np.int64)),
                     pa.array(np.concatenate([w[2] for w in went]))], ["shard", "fp", "home"])

    def search(table: pa.Table) -> pa.Table:
        pts = table["fp"].to_numpy().view(np.uint64)
        q = table["shard"][0].as_py() % QUARTERS
        forest = shard_links(pts, table["home"].to_numpy(zero_copy_only=False), masks[q], radius, max_bits)
        at = np.arange(len(pts))
        root = forest.roots(at)
        far = root != at
        return pa.table({"a": pts[root[far]].view(np.int64), "b": pts[at[far]].view(np.int64)})

    return (reps.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
            .groupBy("shard").applyInArrow(search, "a long, b long"))


# ------------------------------------------------------------ connected components
def connected(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of every component of ``edges`` (a, b).

    Alternating large-star and small-star steps; every round is written to the
    shared folder.  Minima are pre-aggregated, so a hub costs one row per task.
    Nodes that have no edge are absent.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both, low, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, "u", "v").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def rooted(fps: DataFrame, max_bits: int = MAX_BITS, **search) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``fps`` (doc_id, fp);
    ``root`` is the component's fingerprint, one for each component."""
    fps = written(fps, "simhash")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "reps")
    roots = connected(links(reps, max_bits, **search))
    member = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = written(member, "members")
    low = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = salted_join(member, low, "root", "fp").select("fp", "root", "component_id")
    # all empty texts share a fingerprint, so its rows are dealt over several tasks
    return salted_join(fps, named, "fp", "doc_id", salts=8).select("doc_id", "fp", "root", "component_id")


def components(fps: DataFrame, max_bits: int = MAX_BITS, **search) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``fps`` (doc_id, fp).

    component_id is the smallest doc_id reachable over links of at most
    ``max_bits`` bits.  Rows with a null doc_id take part in linking; a
    component made only of them has a null id.  Repeated rows stay repeated.
    """
    return rooted(fps, max_bits, **search).drop("root")


def simhash_components(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; extra columns
    are ignored, and an empty table gives no row."""
    out = components(fingerprints(docs, k), max_bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component stays: the one of smallest doc_id.

    Rows of that doc_id in the same component are copies too: one stays, of the
    smallest text.  Rows that share a doc_id but lie in different components are
    different documents, and each component keeps its own.  Documents without an
    id cannot be named as copies and all stay.  An empty table stays empty.
    """
    found = written(rooted(fingerprints(docs, k), max_bits).where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "_id"), "copies")
    ids = found.groupBy("_id").agg(F.count("*").alias("_rows"), F.max(F.col("_id") == F.col("component_id")).alias("_first"))
    kept = found.where("_id = component_id").select("_id", "fp", "root").distinct()
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.struct(*docs.columns).alias("_d"))
    # both joins deal the documents out alike, so their texts are shuffled once
    alone = named.join(ids.where("_rows = 1 AND _first").select("_id"), "_id", "left_semi").select("_d.*")
    several = named.join(ids.where("_rows > 1").select("_id"), "_id", "left_semi").withColumn("text", F.col("_d.text"))
    # only rows that share their id need their fingerprints beside them
    order = [F.col("text").isNull(), F.col("text"), F.expr("_d.source"), F.expr("_d.lang")]
    shared = (with_fingerprint(several, k).join(kept, ["_id", "fp"])
              .withColumn("_n", F.row_number().over(Window.partitionBy("_id", "root").orderBy(*order)))
              .where("_n = 1").select("_d.*"))
    return alone.unionByName(shared).unionByName(docs.where("doc_id IS NULL"))
