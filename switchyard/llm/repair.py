"""Repair of a conversation's structure by Wagner-Fischer target alignment.

A repaired conversation reads as one of the target strings of the grammar
``(s?(ua)+)?`` over its roles' initials: nothing, or an alternation of user and
assistant that ends with the assistant, after at most one system turn.  Turns
are aligned to each feasible length of that alternation: to keep a turn costs
0, to give it the role of user or assistant 3, to delete it 4, to insert an
empty turn 3, and a truncated turn that stays costs 3 more; blank and repeated
turns must go.  Targets of all lengths end alike, so one table of suffix costs
(turns left by target roles left) serves every length.  Ukkonen's band leaves
out the cells that cost more than the incumbent, a plain repair made first.
Every length of the least cost is traced back and the audits (the initials of
the edits, in order) are compared; the smallest one is the repair.

Spark drops nothing of a conversation: its turns are dealt by conv_id, sorted,
and streamed, so that a task holds one conversation and not a partition.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import short_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACES = " \t\n\x0b\f\r"
_NEVER = np.int64(1) << 40
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string, repaired string")


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the turns with the faults that
    crc32(``conv_id:turn``) modulo 20 gives them; a dropped turn stays as a row
    with ``gone``.  A null role, text or (in the hashed string) turn is one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.coalesce("text", space)
    found = turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("gone"), F.when(fault == 3, 2).otherwise(1).alias("_n"))
    return found.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")


def truncated(text: Column) -> Column:
    """Whether the last character that is no space is no end of a sentence."""
    return ~F.right(F.rtrim(text, F.lit(_SPACES)), F.lit(1)).isin(".", "!", "?")


class Alignment:
    """Suffix costs of one conversation against alternations of every length.

    ``initials``: role initials; ``must_go``: blank or repeated turns; ``cut``:
    truncated turns.  Row i of the table is over r, the target roles left when
    the turns from i on are left; the next role is u for an even r, else a.
    Only about 2 sqrt(n) rows are kept, the others are computed again in blocks.
    """

    def __init__(self, initials: list[str], must_go: list[bool], cut: list[bool]):
        self.n, self.initials, self.must_go = len(initials), initials, must_go
        self.keep = [TRUNCATED * c for c in cut]
        self.bound = self.incumbent()
        self.down, self.up = self.bound // DELETE, self.bound // INSERT
        # kept: the roles left to align are within [q - down, q + up] of the q turns left
        self.width = self.down + self.up + 1
        self.block = max(1, math.isqrt(self.n))
        self.checkpoints: dict[int, np.ndarray] = {}
        self.held: tuple[int, list[np.ndarray]] = (-1, [])
        row = self.last()
        for i in range(self.n, -1, -1):
            if i < self.n:
                row = self.before(i, row)
            if i % self.block == 0 or i == self.n:
                self.checkpoints[i] = row

    def incumbent(self) -> int:
        """Cost of a plain repair: blank and repeated turns and every system turn
        but a first one go, a turn out of turn gets the missing one before it."""
        cost, want = 0, "u"
        for i, initial in enumerate(self.initials):
            if self.must_go[i]:
                cost += DELETE
            elif initial in ("u", "a"):
                if initial != want:
                    cost += INSERT
                cost += self.keep[i]
                want = "a" if initial == "u" else "u"
            else:
                cost += DELETE
        return min(cost + INSERT * (want == "a"), DELETE * self.n)

    def low(self, i: int) -> int:
        """The r of the first cell of row i."""
        return self.n - i - self.down

    def last(self) -> np.ndarray:
        r = np.arange(self.low(self.n), self.low(self.n) + self.width)
        return np.where(r < 0, _NEVER, INSERT * r)

    def before(self, i: int, after: np.ndarray) -> np.ndarray:
        """Row i from row i + 1.  Its first cell has one r more, so cell k of row
        i + 1 lies one r below cell k of row i."""
        low = self.low(i)
        row = np.append(after[1:], _NEVER) + DELETE
        if not self.must_go[i]:
            fit = np.full(self.width, REROLE + self.keep[i])
            if self.initials[i] in ("u", "a"):
                fit[(low + (self.initials[i] == "a")) % 2::2] = self.keep[i]
            row = np.minimum(row, after + fit)
        r = INSERT * np.arange(self.width)
        row = np.minimum.accumulate(row - r) + r
        if low < 0:
            row[:-low] = _NEVER
        if low <= 0:  # r = 0: nothing but deletions
            row[-low] = DELETE * (self.n - i)
            row[-low:] = np.minimum.accumulate(row[-low:] - r[:self.width + low]) + r[:self.width + low]
        return np.minimum(row, _NEVER)

    def row(self, i: int) -> np.ndarray:
        if i in self.checkpoints:
            return self.checkpoints[i]
        top = min((i // self.block + 1) * self.block, self.n)
        if self.held[0] != top:
            rows = [self.checkpoints[top]]
            for k in range(top - 1, top - self.block, -1):
                rows.append(self.before(k, rows[-1]))
            self.held = (top, rows)
        return self.held[1][top - i]

    def cost(self, i: int, r: int) -> int:
        """Least cost of the turns from i on against the last r roles of a target."""
        k = r - self.low(i)
        return int(self.row(i)[k]) if 0 <= k < self.width else int(_NEVER)

    def starts(self) -> list[tuple[int, int, int]]:
        """(turn of the system role or -1, r, cost) of every feasible target in the band."""
        even = range(max(0, self.low(0) + self.low(0) % 2), self.low(0) + self.width, 2)
        found = [(-1, r, self.cost(0, r)) for r in even]
        for i, initial in enumerate(self.initials):
            if DELETE * i > self.bound:
                break
            if initial == "s" and not self.must_go[i]:
                low = self.low(i + 1)
                found += [(i, r, DELETE * i + self.keep[i] + self.cost(i + 1, r))
                          for r in range(max(2, low + low % 2), low + self.width, 2)]
        return found

    def trace(self, i: int, r: int) -> str:
        """The least audit of the turns from i on against the last r roles: of the
        edits that keep the cost, the first letter of the alphabet each time."""
        out = []
        while i < self.n or r:
            here = self.cost(i, r)
            if i < self.n and DELETE + self.cost(i + 1, r) == here:
                out.append("D")
                i += 1
            elif r and INSERT + self.cost(i, r - 1) == here:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.initials[i] == "ua"[r % 2] else "R")
                i, r = i + 1, r - 1
        return "".join(out)

    def best(self) -> tuple[int, str, bool]:
        """(cost, audit, whether the first kept turn is a system turn)."""
        starts = self.starts()
        least = min(cost for _, _, cost in starts)
        audit, system = min(("D" * i + "K" + self.trace(i + 1, r) if i >= 0 else self.trace(0, r), i >= 0)
                            for i, r, cost in starts if cost == least)
        return least, audit, system


def rebuilt(audit: str, system: bool, roles: list[str], texts: list[str]) -> str:
    """The repaired turns as ``role:text`` lines."""
    lines, i, at = [], 0, 0
    for edit in audit:
        target = ("user", "assistant")[(at - system) % 2]
        if edit == "I":
            lines.append(f"{target}:")
        elif edit != "D":
            lines.append(f"{roles[i] if edit == 'K' else target}:{texts[i]}")
        at += edit != "D"
        i += edit != "I"
    return "\n".join(lines)


def judge(turns: list[int | None], roles: list[str], texts: list[str], ends_cut: list[bool]) -> tuple:
    """The result's columns after conv_id, for the turns of one conversation in order."""
    known = {t for t in turns if t is not None}
    seen, blank, repeated, cut = set(), [], [], []
    for role, text, ends in zip(roles, texts, ends_cut, strict=True):
        empty = not text.strip(_SPACES)
        blank.append(empty)
        repeated.append(not empty and (role, text) in seen)
        cut.append(not empty and not repeated[-1] and ends)
        seen.add((role, text))
    initials = [role[:1] for role in roles]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, system = Alignment(initials, [a or b for a, b in zip(blank, repeated, strict=True)], cut).best()
    text = rebuilt(audit, system, roles, texts)
    return (max(known) - min(known) + 1 - len(known) if known else 0, sum(blank), sum(repeated), sum(cut), illegal, cost, audit,
            hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), text)


def _conversations(batches) -> Iterator[tuple[int, list[list]]]:
    """(conv_id, rows) of rows that come sorted by conversation."""
    at, rows = None, []
    for b in batches:
        for conv, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if conv != at:
                if at is not None:
                    yield at, rows
                at, rows = conv, []
            rows.append(row)
    if at is not None:
        yield at, rows


def repair(turns: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256 and, unless ``with_text`` is false, the repaired text.

    ``turns``: conv_id, turn, role, text (no nulls in role and text) and ``gone``,
    true on rows that only keep a conversation in the result.  Turns are taken by
    turn (nulls first), ties by role and text, so repeated rows are neighbours.
    A conversation without turns has zeros, an empty audit and the hash of the
    empty string.  Rows without conv_id belong to no conversation and are left
    out; an empty table has none.  A role is kept by its first character, so
    an empty role fits no place.  Texts are whole; the work for a conversation is
    its turns times the band of its incumbent, its memory the band times the
    square root of its turns.
    """
    def run(batches):
        out, held = [], 0
        for conv, rows in _conversations(batches):
            rows = [r for r in rows if not r[4]]
            out.append((conv, *judge(*[list(c) for c in zip(*[r[:4] for r in rows])] if rows else ([], [], [], []))))
            if not with_text:
                out[-1] = out[-1][:-1]
            held += len(out[-1][-1]) if with_text else 256
            if held > 4 << 20 or len(out) >= 1000:
                yield emit(out)
                out, held = [], 0
        if out:
            yield emit(out)

    def emit(out):
        types = [pa.int64()] * 7 + [pa.string()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = RESULT if with_text else RESULT.rpartition(",")[0]
    names = [c.split()[0] for c in schema.split(", ")]
    known = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", truncated(F.col("text")).alias("cut"), "gone")
    dealt = short_batches(known).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, schema)
