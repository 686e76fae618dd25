"""Concatenate-and-cut packing of token ids into fixed sequences.

Pass one tokenises every document once and writes its ids beside the task's
partition number and the document's offset inside that partition.  The token
totals of the partitions (one number each) are summed up to every partition's
global offset.  Pass two reads the table again and cuts each document where
the global offset crosses a multiple of the sequence length.  Nothing is
shuffled; only the last sequence can need padding.
"""

from __future__ import annotations

import functools
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import short_batches, slices, written

SEQUENCE_TOKENS = 2048
END_ID = 1
_OUT_BYTES = 4 << 20


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _edge(c: str) -> bool:
    """A character that certainly is no white space for the tokenizer."""
    return "!" <= c <= "~" or c.isalnum()


class Encoder(dict):
    """Text to ids, equal to the tokenizer file's, with the ids of " word" remembered.

    The tokenizer never joins what a single space parts: a text cut at such
    spaces can be encoded piece by piece.  Where a piece begins or ends with
    anything but a plain character the pieces are put together again first.
    """

    LIMIT = 150_000

    def __init__(self, json_path: str, ranks_path: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.json_path = json_path
        self.dtype = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for token, i in ranks.items() if token[0] == 32]] = True
        self.raw = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={}).encode_ordinary

    @functools.cached_property
    def whole(self):
        """The tokenizer itself, for texts that spell out one of its special tokens."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.json_path)

    def _ids(self, piece: str) -> bytes:
        return np.array(self.raw(piece), self.dtype).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of the pieces that begin and end plainly, each after a space.

        They are encoded in one go; a piece holds no space, so its first id is
        the only one whose bytes begin with one.
        """
        if len(self) >= self.LIMIT:
            self.clear()
        new = [p for p in pieces.difference(self) if p and _edge(p[0]) and _edge(p[-1])]
        if new:
            ids = np.array(self.raw(" " + " ".join(new)), self.dtype)
            at = np.flatnonzero(self.opens[ids]) * ids.itemsize
            raw = ids.tobytes()
            self.update(zip(new, [raw[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(raw)])], strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out, lo = [], 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and held < 1 << 21:
                held += len(texts[hi])
                hi += 1
            parts = [t.split(" ") for t in texts[lo:hi]]
            self.learn(set().union(*[p[1:] for p in parts]))
            out += map(self._encode, texts[lo:hi], parts)
            lo = hi
        return out

    def _encode(self, text: str, parts: list[str]) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        first, *rest = parts
        if not rest:
            return self._ids(text)
        if first and _edge(first[-1]):
            try:
                return self._ids(first) + b"".join(map(self.__getitem__, rest))
            except KeyError:
                pass
        out, group = [], [first]
        for piece in rest:
            if piece and group[-1] and _edge(piece[0]) and _edge(group[-1][-1]):
                out.append(" ".join(group))
                group = [piece]
            else:
                group.append(piece)
        out.append(" ".join(group))
        return self._ids(out[0]) + b"".join([self._ids(" " + p) for p in out[1:]])


@functools.lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def tokenized(docs: DataFrame, json_path: str, ranks_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, tokens, part, before): ids as little-endian 32-bit or, for
    a small vocabulary, 16-bit numbers, ``end_id`` last; ``before`` counts the
    tokens of the partition's earlier documents.  Null text: only ``end_id``."""
    def run(batches):
        enc = encoder(json_path, ranks_path)
        end = np.array([end_id], enc.dtype).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            ids = [x + end for x in enc.encode_batch([t or "" for t in b.column(1).to_pylist()])]
            n = [len(x) // enc.dtype().itemsize for x in ids]
            at = list(accumulate(n, initial=before))
            before = at.pop()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64()),
                 pa.array([part] * len(n), pa.int64()), pa.array(at, pa.int64())],
                ["doc_id", "ids", "tokens", "part", "before"])

    return short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, ids binary, tokens long, part long, before long")


def pack(docs: DataFrame, length: int = SEQUENCE_TOKENS, end_id: int = END_ID, files: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian
    32-bit), doc_tokens, sequence_id, offset.

    Every id of every row of ``docs`` lies in one piece; rows that share a
    doc_id are packed each on its own.  An empty table gives no piece.
    """
    json_path, ranks_path = files or tokenizer_files()
    narrow = encoder(json_path, ranks_path).dtype
    table = written(tokenized(docs, json_path, ranks_path, end_id), "tokens")
    # One number for each task of pass one.
    totals = sorted(table.groupBy("part").agg(F.sum("tokens")).collect())
    base = dict(zip([r[0] for r in totals], accumulate([r[1] for r in totals], initial=0)))

    def emit(rows):
        cols = list(zip(*rows))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def cut(batches):
        rows, held = [], 0
        for b in slices(batches):
            for doc, ids, n, part, before in zip(*[c.to_pylist() for c in b.columns]):
                at = base[part] + before
                ids = np.frombuffer(ids, narrow).astype("<u4").tobytes()
                start = 0
                while start < n:
                    seq, off = divmod(at + start, length)
                    size = min(n - start, length - off)
                    rows.append((doc, start, size, ids[4 * start:4 * (start + size)], n, seq, off))
                    start += size
                held += len(ids)
                if held >= _OUT_BYTES:
                    yield emit(rows)
                    rows, held = [], 0
        if rows:
            yield emit(rows)

    return table.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
