"""Best-two-fit packing of token ids into sequences.

Pass one tokenises every document once, cuts it into pieces of at most one
sequence and numbers the pieces of each length inside their task.  A packing
sees nothing of a piece but its length, so the driver plans on the counts of
the lengths alone (at most ``capacity`` numbers, whatever the table's size):
a bin is filled greedily, longest first, and then its smallest document gives
way to the two unpacked documents that fill the expanded gap most tightly.
As long as the counts of its lengths last, the same bin comes again, so a plan
is a list of bin patterns with a number of repeats.  Pass two turns a piece's
global number among the pieces of its length (the task's base plus its number
inside the task) into its bin and its place there.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.llm.common import short_batches, slices, written

SEQUENCE_TOKENS = 2048
END_ID = 0

#: Letters of the Latin blocks that are composed, have one lower-case letter and
#: keep together in the tokenizer (U+0130 lowers to two characters).
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_LETTER_RUN = re.compile(f"[{_LETTERS}]+")
#: Marks that end a word; an apostrophe can open a word of its own.
_TAIL = rf"([{_LETTERS}])([!-&(-/:-@\[-`{{-~]+)( |$)"
#: Bytes of text whose words are looked up together.
_BATCH_BYTES = 2 << 20


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, int]:
    """The letter by which the vocabulary writes each byte: bytes that print stand
    for themselves, the others follow from U+0100 on.  A space stays one."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return dict(zip(prints, prints)) | {b: 0x100 + i for i, b in enumerate(others)} | {0x20: 0x20}


class WordEncoder(dict):
    """Texts to ids, equal to the tokenizer file's, with the ids of words remembered.

    The tokenizer lowers letters, drops white space and never joins what a space
    parts, so the ids of a text are those of its space-separated words, one after
    the other.  The marks that end a word are a word of their own to it, too.
    """

    LIMIT = 400_000

    def __init__(self, path: str):
        import json
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # for words that need no more than the merges
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _bytes(self, encodings) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in encodings]

    def _run_ids(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters, many at a time: each ends with its only end-of-word id."""
        lines = [" ".join(runs[lo:lo + 256]).lower().encode().decode("latin-1").translate(self.letters) for lo in range(0, len(runs), 256)]
        raw = b"".join(self._bytes(self.merges.encode_batch_fast(lines, add_special_tokens=False)))
        stops = ((np.flatnonzero(self.ends[np.frombuffer(raw, self.dtype)]) + 1) * self.dtype.itemsize).tolist()
        return list(map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)))

    def learn(self, words: list[str]) -> None:
        """Remember the words' ids."""
        if len(self) >= self.LIMIT:
            self.clear()
        new = [w for w in words if w not in self]
        if runs := list(filter(_LETTER_RUN.fullmatch, new)):
            self.update(zip(runs, self._run_ids(runs), strict=True))
        if other := [w for w in new if w not in self]:
            self.update(zip(other, self._bytes(self.tokenizer.encode_batch_fast(other, add_special_tokens=False)), strict=True))

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """Parts of each text that are encoded on their own.  Marks are cut off and
        ASCII lowered where no special token can come about and no mark can join a letter."""
        spaced = pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " ")
        odd = pc.match_substring_regex(spaced, "[\u0300-\U0010ffff]")
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(spaced, token, ignore_case=True))
        cut = pc.replace_substring_regex(pc.ascii_lower(spaced), _TAIL, r"\1 \2\3")
        return pc.split_pattern(pc.if_else(odd, spaced, cut), " ")

    def encode_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        groups = np.flatnonzero(np.diff(ends // _BATCH_BYTES, prepend=0, append=-1)).tolist()
        return [ids for lo, hi in zip([0, *groups], groups) if hi > lo for ids in self._encode(texts.slice(lo, hi - lo))]

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        parts = self._split(texts)
        coded = parts.flatten().dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.learn(words)
        known = list(map(self.__getitem__, words))
        table = np.frombuffer(b"".join(known), self.dtype)
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        start = np.cumsum(size) - size
        n = size[which]
        end = np.cumsum(n)
        ids = table[np.arange(end[-1]) + np.repeat(start[which] - (end - n), n)]
        return np.split(ids, np.concatenate([[0], end])[parts.offsets.to_numpy()[1:-1] - parts.offsets[0].as_py()])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, part, nth): the pieces of
    every document; ``nth`` counts the task's earlier pieces of that length."""
    def run(batches):
        enc = encoder(path)
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in slices(batches):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_texts(b.column(1)), strict=True):
                ids = np.append(ids, enc.dtype.type(end_id))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start:start + capacity]
                    n = len(piece)
                    rows.append((doc, k, start, n, piece.tobytes(), zlib.crc32(piece.astype("<u4").tobytes()), part, seen[n]))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE_TYPES, strict=True)], _PIECE_NAMES)

    return short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part long, nth long")


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins of best-two-fit for ``counts`` documents of each length: (repeats,
    [(length, documents of it in a bin)]).

    Every pattern leaves one of its lengths with fewer documents than a bin
    took, and those last for at most ``capacity / length`` more patterns, so
    there are at most about ``capacity * (1 + ln capacity)`` of them.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(capacity + 1)
    out = []
    while True:
        fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # longest left of at most x
        gap, take = capacity, {}
        at = int(fits[gap])
        if not at:
            return out
        while at:
            take[at] = min(int(left[at]), gap // at)
            gap -= at * take[at]
            at = int(fits[min(gap, at - 1)])
        smallest = min(take)
        if gap and sum(take.values()) > 1:
            spare = left.copy()
            spare[list(take)] -= list(take.values())
            room = gap + smallest
            pair = tightest_pair(spare[:room], room)
            if sum(pair) > smallest:
                take = Counter(take) + Counter(pair)
                take[smallest] -= 1
        take = {length: n for length, n in take.items() if n}
        repeats = min(int(left[length]) // n for length, n in take.items())
        left[list(take)] -= repeats * np.array(list(take.values()))
        out.append((repeats, sorted(take.items(), reverse=True)))


def tightest_pair(spare: np.ndarray, room: int) -> tuple[int, int]:
    """The two spare documents of the largest total of at most ``room`` (ties:
    with the longest one); (0, 0) if no two fit."""
    lengths = np.arange(len(spare))
    fits = np.maximum.accumulate(np.where(spare > 0, lengths, 0))
    a = np.flatnonzero(spare[1:] > 0) + 1
    if not len(a):
        return 0, 0
    b = fits[np.minimum(room - a, a)]
    alone = (b == a) & (spare[a] < 2)
    b = np.where(alone, fits[a - 1], b)
    total = np.where(b > 0, a + b, 0)
    best = len(a) - 1 - int(np.argmax(total[::-1]))
    return (int(a[best]), int(b[best])) if total[best] else (0, 0)


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as a table sorted by (length, number among the pieces of that
    length): first number, first bin, pieces in a bin, offset of the first one."""
    used, rows, first_bin = Counter(), [], 0
    for repeats, content in patterns:
        offset = 0
        for length, n in content:
            rows.append((length, used[length], first_bin, n, offset))
            used[length] += repeats * n
            offset += length * n
        first_bin += repeats
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "number", "bin", "each", "offset"), cols, strict=True))


def pack(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of little-endian
    32-bit ids), sequence_id, offset and, unless ``with_ids`` is false, ids
    (binary, little-endian, 16-bit where the vocabulary allows).

    A document has the ids of its text and ``end_id``; only one of more than
    ``capacity`` ids is cut, and its last piece is packed like a short document.
    Null text: only ``end_id``.  Every row is packed on its own, also rows that
    repeat or share a doc_id (null too); equal lengths are dealt in the order of
    the tasks.  An empty table gives no piece.  Other columns are not read.
    """
    table = written(pieces(docs, path or tokenizer_file(), capacity, end_id), "pieces")
    counts = table.groupBy("part", "length").agg(F.count("*").alias("n"))
    # One number for each length.
    total = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    at = places(plan(total, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    carried = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    numbered = table.join(base, ["part", "length"]).select((F.col("base") + F.col("nth")).alias("number"), *carried)
    step = max(total.values(), default=1)
    keys = at["length"] * step + at["number"]  # a length is at most the capacity, so this stays far below 2^63

    def place(batches):
        for b in batches:
            number, length = (b.column(name).to_numpy() for name in ("number", "length"))
            i = np.searchsorted(keys, length * step + number, side="right") - 1
            bins, slot = np.divmod(number - at["number"][i], at["each"][i])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(at["bin"][i] + bins), pa.array(at["offset"][i] + slot * length)],
                                             [*carried, "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                               + "ids binary, " * with_ids + "sequence_id long, offset long")
