"""Prefix trie of conversations, as balanced parentheses in shards.

A conversation is a path of turns; a path is the text of its turns' digests, 16
bytes each.  Paths are sorted over all shards (range partitions), so the members
of a node are neighbours and only the prefixes of a shard's first and last path,
its spines, can have members elsewhere.  A shard writes its trie as balanced
parentheses.  Blocks of the running excess, with a tree of their minima, answer
``find_close`` and so delimit every node's subtree; the rank of the leaf pairs
``()`` counts its leaves, and cumulative arrays in the order of the nodes give
its members and savings.  Spines go on as paths with what hangs from each of
their nodes: they are sorted and merged by the same code, level by level, until
one shard holds them all.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import salted_join, short_batches, shuffle_partitions, written

WIDTH = 16
#: Turns and conversations of a shard: at most, and at least where there are shuffle partitions for more shards.
SHARD, SMALL_SHARD = 1 << 20, 1 << 12
#: Spines merged in one task.
SPINES = 1 << 12
#: Ids in a row of the table from which hashes of long lists are made.
CHUNK = 1 << 14
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_COUNTS = ["convs", "smallest", "leaves", "saved", "children"]
_LONGS = pa.list_(pa.int64())
_OUT = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), *[(c, pa.int64()) for c in NODE[:-1]],
                  ("ends_sha256", pa.string()), ("ids", pa.string()), ("path", pa.binary()), ("sizes", _LONGS), *[(c, _LONGS) for c in _COUNTS]])
_DDL = ", ".join(["kind string, key binary, parent_key binary", *[f"{c} long" for c in NODE[:-1]], "ends_sha256 string, ids string, path binary, sizes array<long>",
                  *[f"{c} array<long>" for c in _COUNTS]])


def digest(role: Column, text: Column) -> Column:
    """32 hexadecimal digits of a turn's role and text."""
    return F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size) of every row with a conv_id; null role or text: empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("size"))


def as_path(conv_id: Column, turns: Column) -> list[Column]:
    """Columns conv_id, path and sizes of an array of turns in order."""
    return [conv_id.alias("conv_id"), F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), "")).alias("path"),
            F.transform(turns, lambda t: t["size"]).alias("sizes")]


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): a conversation's turns by turn (null first), ties by digest."""
    turns = turns_of(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))
    return turns.select(*as_path(F.col("conv_id"), F.col("turns")))


def rebuilt_paths(conversations: DataFrame, family: int = 5, shared: int = 9) -> DataFrame:
    """``paths`` of conversations that begin like the first one of their family:
    its first h turns, then the own turns after the first h, h being the crc32 of
    the decimal conv_id modulo ``shared``.  A family is ``family`` neighbouring
    ids, dealt together, so that no join is needed."""
    turns = turns_of(conversations).withColumn("first_id", F.col("conv_id") - F.col("conv_id") % family)
    dealt = turns.repartition(shuffle_partitions(turns.sparkSession), "first_id")
    own = dealt.groupBy("first_id", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))
    families = own.groupBy("first_id").agg(F.collect_list(F.struct("conv_id", "turns")).alias("all"))
    first = F.flatten(F.transform(F.filter("all", lambda c: c["conv_id"] == F.col("first_id")), lambda c: c["turns"]))
    each = families.select(first.alias("first"), F.explode("all").alias("own")).select("first", "own.conv_id", "own.turns")
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % shared).cast("int")
    mixed = each.withColumn("turns", F.concat(F.slice("first", F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))))
    return mixed.select(*as_path(F.col("conv_id"), F.col("turns")))


class Parentheses:
    """Balanced parentheses with a tree of range minima over their excess."""

    BLOCK, FAN = 64, 16

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int32)
        self.blocks = self._grouped(self.excess, self.BLOCK)
        self.tree = []  # from the block minima up, in groups
        mins = self.blocks.min(axis=1)
        while len(mins) > 1:
            self.tree.append(self._grouped(mins, self.FAN))
            mins = self.tree[-1].min(axis=1)

    @staticmethod
    def _grouped(values: np.ndarray, n: int) -> np.ndarray:
        pad = np.full(-len(values) % n, np.iinfo(np.int32).max, np.int32)
        return np.concatenate([values, pad]).reshape(-1, n)

    @staticmethod
    def _first(table: np.ndarray, at: np.ndarray, target: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First column of row ``at`` beyond ``after`` whose value is at most the target, and whether there is one."""
        fits = (table[at] <= target[:, None]) & (np.arange(table.shape[1]) > after[:, None])
        return fits.argmax(axis=1), fits.any(axis=1)

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        return np.concatenate([self._find_close(opens[lo:lo + 8192]) for lo in range(0, len(opens), 8192)])

    def _find_close(self, opens: np.ndarray) -> np.ndarray:
        target = self.excess[opens] - 1
        block = opens // self.BLOCK
        at, found = self._first(self.blocks, block, target, opens % self.BLOCK)
        out = np.where(found, block * self.BLOCK + at, -1)
        todo, node, height = np.flatnonzero(~found), block[~found], 0
        while len(todo):  # climb until a later sibling reaches the target, then descend
            group = node // self.FAN
            at, found = self._first(self.tree[height], group, target[todo], node % self.FAN)
            done, below = todo[found], group[found] * self.FAN + at[found]
            for level in self.tree[:height][::-1]:
                below = below * self.FAN + self._first(level, below, target[done], np.full(len(done), -1))[0]
            out[done] = below * self.BLOCK + self._first(self.blocks, below, target[done], np.full(len(done), -1))[0]
            todo, node, height = todo[~found], group[~found], height + 1
        return out

    def leaf_pairs(self) -> np.ndarray:
        """Whether each open parenthesis is closed at once."""
        opens = np.flatnonzero(self.bits)
        return ~self.bits[opens + 1]


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n // WIDTH  # low turns agree, high do not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid * WIDTH] == b[:mid * WIDTH] else (low, mid)
    return low


def keys_of(path: bytes) -> list[bytes]:
    """Key of each prefix of a path: the digest of its parent's key and its last turn."""
    keys = [b"root"]
    for at in range(0, len(path), WIDTH):
        keys.append(hashlib.md5(keys[-1] + path[at:at + WIDTH]).digest())
    return keys


class Shard:
    """The trie of paths that come in order."""

    def __init__(self):
        self.path, self.line, self.first = None, [0], None
        self.steps: list[tuple[int, int]] = []  # parentheses closed, then opened
        self.sizes, self.paths = [0], 0
        self.counts = {c: [0] for c in _COUNTS}
        self.counts["smallest"] = [np.iinfo(np.int64).max]
        self.keys: dict[int, bytes] = {}

    def add(self, path: bytes, sizes: list[int]) -> list[int]:
        """The nodes of the path, from the root on."""
        if path == self.path:
            return self.line
        before, depth = self.path or b"", len(path) // WIDTH
        shared, n = common_turns(before, path), len(self.sizes)
        self.steps.append((len(before) // WIDTH - shared, depth - shared))
        self.line = self.line[:shared + 1] + list(range(n, n + depth - shared))
        self.sizes.extend(sizes[shared:])
        for name, column in self.counts.items():
            column.extend([np.iinfo(np.int64).max if name == "smallest" else 0] * (depth - shared))
        self.path = path
        if self.first is None:
            self.first = (path, self.line, sizes)
        self.last_sizes = sizes
        return self.line

    def add_keys(self, line: list[int], path: bytes) -> None:
        self.keys.update(zip(line, keys_of(path), strict=True))

    def parentheses(self) -> Parentheses:
        runs = np.array([1, *[n for step in self.steps for n in step], len(self.path) // WIDTH + 1])
        return Parentheses(np.repeat(np.arange(len(runs)) % 2 == 0, runs))  # the root opens; close, open, close ...

    def solve(self, last: bool) -> None:
        """Values of all nodes; of a spine node, unless this is the last level,
        those of what hangs from it without another spine node between."""
        n = len(self.sizes)
        p = self.parentheses()
        opens = np.flatnonzero(p.bits)
        end = np.arange(n) + (p.find_close(opens) - opens + 1) // 2  # first node after the subtree
        self.depth = p.excess[opens].astype(np.int64) - 1
        convs, self.smallest, leaves, saved, children = (np.array(self.counts[c], np.int64) for c in _COUNTS)
        self.spine = np.zeros(n, bool)
        if not last:
            self.spine[self.first[1]] = self.spine[self.line] = True

        def subtree(values):
            total = np.concatenate([[0], np.cumsum(values)])
            return total[end] - total[:-1]

        order = np.argsort(self.depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)
        self.parent = np.full(n, -1)
        for above, level in zip(levels[:-1][::-1], levels[:0:-1], strict=True):
            self.parent[level] = above[np.searchsorted(above, level) - 1]
            np.minimum.at(self.smallest, self.parent[level], self.smallest[level])
        inner = np.flatnonzero(~self.spine & (self.parent >= 0))
        self.children = children + np.bincount(self.parent[inner], minlength=n)
        self.convs = subtree(convs)
        self.leaves = subtree(leaves + (p.leaf_pairs() & (children == 0) & ~self.spine))
        self.saved = subtree(saved + np.where(self.spine, 0, (self.convs - 1) * np.array(self.sizes, np.int64)))
        on = np.flatnonzero(self.spine & (self.parent >= 0))
        hanging = {c: getattr(self, c).copy() for c in ("convs", "leaves", "saved")}
        for c, values in hanging.items():
            np.subtract.at(values, self.parent[on], getattr(self, c)[on])
        self.hanging = hanging | {"smallest": self.smallest, "children": self.children}


def _batch(kind: str, n: int, **columns) -> pa.RecordBatch:
    filled = {"kind": pa.array([kind] * n)} | columns
    return pa.RecordBatch.from_arrays([pa.array(filled[f.name], f.type) if f.name in filled else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def _nodes(shard: Shard, ends: dict[int, list[int]] | None):
    """The finished nodes of a shard; above the first level they have a key, by
    which their list of ends is found."""
    found = np.flatnonzero(~shard.spine)
    for lo in range(0, len(found), 10_000):
        at = found[lo:lo + 10_000]
        parent = shard.parent[at]
        outside = (parent >= 0) & shard.spine[parent]
        if ends is None:
            named = {"key": [shard.keys[i] for i in at.tolist()]}
        else:
            named = {"ends_sha256": [_sha(ends[i]) if i in ends else EMPTY_SHA for i in at.tolist()]}
        yield _batch("node", len(at), conv_id=shard.smallest[at], depth=shard.depth[at],
                     parent_key=[shard.keys[i] if out else None for i, out in zip(parent.tolist(), outside.tolist(), strict=True)],
                     parent_conv_id=pa.array(shard.smallest[parent], mask=outside | (parent < 0)), n_convs=shard.convs[at],
                     n_children=shard.children[at], n_leaves=shard.leaves[at], saved_tokens=shard.saved[at], **named)


def _spines(shard: Shard):
    """The shard's first and last path, with what hangs from their nodes; nodes on both count in the first."""
    path, line, sizes = shard.first
    values = {c: v[line].tolist() for c, v in shard.hanging.items()}
    yield _batch("spine", 1, conv_id=[min(values["smallest"])], path=[path], sizes=[sizes], **{c: [v] for c, v in values.items()})
    if shard.path != path:
        both = common_turns(path, shard.path) + 1
        values = {c: v[shard.line].copy() for c, v in shard.hanging.items()}
        for c, v in values.items():
            if c != "smallest":
                v[:both] = 0
        yield _batch("spine", 1, conv_id=[int(values["smallest"].min())], path=[shard.path], sizes=[shard.last_sizes], **{c: [v.tolist()] for c, v in values.items()})


def _decimal(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(_decimal(ids).encode()).hexdigest()


def _leaf_shards(last: bool):
    """Shards of conversations (conv_id, path, sizes), sorted by path and id."""
    def run(batches):
        shard, ends = Shard(), {}
        for b in batches:
            for conv, path, sizes in zip(*[c.to_pylist() for c in b.columns], strict=True):
                node = shard.add(path, sizes)[-1]
                shard.counts["convs"][node] += 1
                shard.counts["smallest"][node] = min(conv, shard.counts["smallest"][node])
                ends.setdefault(node, []).append(conv)
        if shard.first is None:
            return
        shard.solve(last)
        if not last:
            for path, line in ((shard.first[0], shard.first[1]), (shard.path, shard.line)):
                shard.add_keys(line, path)
            yield from _spines(shard)
            for node in np.flatnonzero(shard.spine).tolist():
                ids = ends.get(node, [])
                for lo in range(0, len(ids), CHUNK):
                    yield _batch("ends", 1, key=[shard.keys[node]], conv_id=[ids[lo]], ids=[_decimal(ids[lo:lo + CHUNK])])
        yield from _nodes(shard, ends)

    return run


def _spine_shards(last: bool):
    """Shards of spines, sorted by path."""
    def run(batches):
        shard = Shard()
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                path, sizes, *values = row
                line = shard.add(path, sizes)
                shard.add_keys(line, path)
                for c, own in zip(_COUNTS, values, strict=True):
                    column = shard.counts[c]
                    for node, v in zip(line, own, strict=True):
                        column[node] = min(v, column[node]) if c == "smallest" else column[node] + v
        if shard.first is None:
            return
        shard.solve(last)
        if not last:
            yield from _spines(shard)
        yield from _nodes(shard, None)

    return run


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows sorted by path over all partitions; one partition is merged without a range."""
    dealt = rows.repartitionByRange(parts, "path", "conv_id") if parts > 1 else rows.repartition(1)
    return dealt.sortWithinPartitions("path", "conv_id")


def hashes_of_ends(chunks: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of each key's chunks, joined in order.  A hash
    runs through its list from one end to the other, so one task reads a
    node's list, chunk by chunk, and holds one chunk."""
    def run(batches):
        at, running, out = None, None, []
        for b in batches:
            for key, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key == at:
                    running.update(b",")
                else:
                    if at is not None:
                        out.append((at, running.hexdigest()))
                    at, running = key, hashlib.sha256()
                running.update(ids.encode())
            if len(out) >= 1000:
                yield emit(out)
                out = []
        if at is not None:
            yield emit([*out, (at, running.hexdigest())])

    def emit(out):
        keys, found = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found)], ["key", "ends_sha256"])

    dealt = short_batches(chunks, 100).select("key", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "conv_id")
    return dealt.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def nodes(convs: DataFrame, shard: int = SHARD, small_shard: int = SMALL_SHARD, spines: int = SPINES) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, path, sizes as of
    ``paths``, one row per conv_id): conv_id (smallest member), depth,
    parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Equal conversations end in one node; a conversation without turns ends in
    the root.  Null roles and texts are empty, rows without conv_id belong to no
    conversation, and turns of one number (null too) stand in the order of their
    digests, each one a turn of its own.  Texts are whole: their digests and sizes stand for
    them.  No conversation gives no node, not even the root.  A path is a row,
    so the longest conversation must fit a task, with some 100 bytes a turn.
    """
    table = written(convs.select("conv_id", "path", "sizes"), "paths")
    turns = table.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(math.ceil(turns / shard), min(shuffle_partitions(table.sparkSession), math.ceil(turns / small_shard)), 1)
    level = written(short_batches(_dealt(table, parts)).select("conv_id", "path", "sizes").mapInArrow(_leaf_shards(parts == 1), _DDL), "trie")
    ends, found = level.where("kind = 'ends'"), [level.where("kind = 'node'")]
    while parts > 1:
        up = level.where("kind = 'spine'").select("path", "sizes", *_COUNTS, "conv_id")
        parts = math.ceil(up.count() / max(spines, 8))  # two spines at most come out of each, so they grow fewer
        dealt = short_batches(_dealt(up, parts), 100).drop("conv_id")
        level = written(dealt.mapInArrow(_spine_shards(parts <= 1), _DDL), "spines")
        found.append(level.where("kind = 'node'"))
    first, *merged = [f.select("key", "parent_key", *NODE) for f in found]
    if not merged:
        return first.select(*NODE)
    spine_nodes = merged[0]
    for m in merged[1:]:
        spine_nodes = spine_nodes.unionByName(m)
    hashed = spine_nodes.drop("ends_sha256").join(hashes_of_ends(ends), "key", "left").fillna(EMPTY_SHA, ["ends_sha256"])
    everything = first.unionByName(hashed.select(first.columns))
    parents = spine_nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    hanging = salted_join(everything.where("parent_key IS NOT NULL"), parents, "parent_key", "conv_id")
    whole = everything.where("parent_key IS NULL").select(*NODE)
    return whole.unionByName(hanging.withColumn("parent_conv_id", F.col("_parent")).select(*NODE))
