"""Exact removal of word passages that already occurred, by super-k-mers.

A window is ``window`` consecutive words of one document.  Its minimiser is
the smallest hash of the ``MINIMISER_WORDS``-word grams inside it.  A run of
consecutive windows with the same minimiser is a super-k-mer: it travels
once, as the packed string of its words, to the bucket of its minimiser, so
all occurrences of a window meet in one bucket.  There the windows of all
strings are sorted and equal ones found (by a 64-bit hash first, then by
their bytes, so a hash collision changes nothing); every window but the
earliest is reported.

A task combines equal super-k-mers before the shuffle: a later occurrence of
a string that this task has already sent from an earlier place is known to
repeat, and only its position travels on, to a bucket of its own document.
A passage that a third of all documents share therefore costs its bucket a
row or so for each map task.  Buckets are counted from the corpus size.

One minimiser is never parted, and a frequent gram may be the minimiser of
many strings that all differ.  A first pass therefore counts the words that
each bucket would get; a bucket above ``BUCKET_WORDS`` gives its windows one
by one to further buckets by a hash of the whole window, so only equal windows
meet there and no bucket grows with the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import mix64, short_batches, shuffle_partitions, slices, split_words, written

WINDOW_WORDS = 20
MINIMISER_WORDS = 4
#: Characters of corpus text for each bucket.
BUCKET_CHARS = 3_000_000
#: Words of strings in one bucket at most; a bucket with more deals its windows out singly.
BUCKET_WORDS = 4_000_000
#: Windows in one packed string at most (longer runs go on in the next string).
MAX_RUN = 512
#: Words of a long document that are handled at once (with an overlap of a window).
SEGMENT_WORDS = 200_000
#: Packed bytes that a task holds before it sends them.
FLUSH_BYTES = 12 << 20
#: Packed strings that a task remembers for combining.
REMEMBERED = 30_000
_CHUNK_WORDS = 60_000
_BASE = 0x9E3779B97F4A7C15
_LAST_ID = (1 << 63) - 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == w else np.minimum(x[:len(x) - (w - width)], x[w - width:])


def gram_hashes(words: list[bytes], m: int) -> np.ndarray:
    """Hash of every ``m`` consecutive words."""
    n = len(words)
    h = mix64(np.fromiter(map(zlib.crc32, words), np.uint64, n) + np.uint64(1))
    gram = np.zeros(n - m + 1, np.uint64)
    for i in range(m):
        gram = mix64(gram + h[i:n - m + 1 + i])
    return gram


def super_kmers(words: list[bytes], segment: np.ndarray, window: int, grams: int = MINIMISER_WORDS):
    """(first word, number of windows, minimiser) of every super-k-mer.

    ``segment`` numbers the stretch each word belongs to; no window crosses two.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64)
    m = min(grams, window)
    low = sliding_min(gram_hashes(words, m), window - m + 1)
    valid = segment[:n - window + 1] == segment[window - 1:]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (segment[1:len(valid)] != segment[:len(valid) - 1])
    start = np.flatnonzero(new)
    stop = np.flatnonzero(np.concatenate(((valid[:-1] & (new[1:] | ~valid[1:])), [valid[-1]]))) + 1
    size = stop - start
    parts = -(-size // MAX_RUN)
    if (parts > 1).any():
        at = np.repeat(np.arange(len(start)), parts)
        step = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = start[at] + step * MAX_RUN, np.minimum(size[at] - step * MAX_RUN, MAX_RUN)
    return start, size, low[start]


def _deal(window: int, buckets: int, hot: tuple[int, ...] = (), extra: int = 0, count: bool = False):
    """Map side: documents (_id, _th, text) to rows of packed strings by bucket.

    The windows of ``hot`` buckets go singly to ``extra`` buckets after the others.
    With ``count``: rows (bucket, n_words, n_windows) of the strings instead."""
    hot_buckets = np.array(sorted(hot), np.int64)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        sent: dict[bytes, tuple[int, int]] = {}
        strings, at, gone, held = [], [], [], 0
        words, segment, origin = [], [], []
        tally = np.zeros((2, buckets if count else 0), np.int64)

        def cut():
            nonlocal words, segment, origin
            seg = np.repeat(np.arange(len(segment)), segment)
            first = np.concatenate(([0], np.cumsum(segment)))
            start, size, low = super_kmers(words, seg, window)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.concatenate(([0], ends[:-1] + 1)) if len(words) else ends
            joined = b" ".join(words)
            bucket = (mix64(low) % np.uint64(buckets)).astype(np.int64)
            parted = np.isin(bucket, hot_buckets)
            if parted.any():
                n = size[parted]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                single = np.repeat(start[parted], n) + step
                there = buckets + (mix64(gram_hashes(words, window)[single]) % np.uint64(extra)).astype(np.int64)
                start, size = np.concatenate((start[~parted], single)), np.concatenate((size[~parted], np.ones_like(single)))
                bucket = np.concatenate((bucket[~parted], there))
            bucket = bucket.tolist()
            size_l, start_l, seg_l = size.tolist(), start.tolist(), seg[start].tolist()
            b_from, b_to = begins[start].tolist(), ends[start + size + window - 2].tolist()
            grown = 0
            for i, b in enumerate(bucket):
                s = joined[b_from[i]:b_to[i]]
                doc, th, base = origin[seg_l[i]]
                here = (doc, start_l[i] - int(first[seg_l[i]]) + base)
                if len(sent) >= REMEMBERED:
                    sent.clear()
                if sent.setdefault(s, here) < here:
                    if not count:
                        gone.append((hash(here) % buckets, doc, th, here[1], size_l[i]))
                else:
                    sent[s] = here
                    if count:
                        tally[0, b] += size_l[i] + window - 1
                        tally[1, b] += size_l[i]
                        continue
                    strings.append(s)
                    at.append((b, doc, th, here[1]))
                    grown += len(s)
            words, segment, origin = [], [], []
            return grown

        def flush():
            a, g = np.array(at, np.int64).reshape(-1, 4), np.array(gone, np.int64).reshape(-1, 5)
            by, gy = np.argsort(a[:, 0], kind="stable"), np.argsort(g[:, 0], kind="stable")
            used = np.union1d(a[:, 0], g[:, 0])
            lo, hi = np.searchsorted(a[by, 0], used), np.searchsorted(a[by, 0], used, "right")
            glo, ghi = np.searchsorted(g[gy, 0], used), np.searchsorted(g[gy, 0], used, "right")
            rows = [], [], []
            for i in range(len(used)):
                pick = by[lo[i]:hi[i]]
                rows[0].append(pack(b"\n".join([strings[j] for j in pick.tolist()])))
                rows[1].append(pack(a[pick, 1:].T.tobytes()))
                rows[2].append(pack(g[gy[glo[i]:ghi[i]], 1:].T.tobytes()))
            strings.clear(), at.clear(), gone.clear()
            return pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(r, pa.binary()) for r in rows]],
                                              ["bucket", "words", "at", "gone"])

        for batch in slices(batches):
            for doc, th, text in zip(*[c.to_pylist() for c in batch.columns]):
                all_words = split_words(text)
                for lo in range(0, max(1, len(all_words) - window + 1), SEGMENT_WORDS):
                    part = all_words[lo:lo + SEGMENT_WORDS + window - 1]
                    if len(part) < window:
                        continue
                    words += part
                    segment.append(len(part))
                    origin.append((doc, th, lo))
                    if len(words) >= _CHUNK_WORDS:
                        held += cut()
                        if held >= FLUSH_BYTES:
                            held = 0
                            yield flush()
        if words:
            cut()
        if at or gone:
            yield flush()
        if count:
            used = np.flatnonzero(tally[0])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, *tally[:, used])], ["bucket", "n_words", "n_windows"])

    return run


def window_hashes(text: bytes, window: int):
    """Of newline-separated strings: (string number, window number in it, first
    byte, last byte + 1, hash) of every window."""
    raw = np.frombuffer(text, np.uint8)
    place = np.int32 if len(raw) < 1 << 31 else np.int64
    gaps = np.flatnonzero((raw == 32) | (raw == 10)).astype(place)
    begins, ends = np.append(place(0), gaps + place(1)), np.append(gaps, place(len(raw)))
    line = np.append(place(0), np.cumsum(raw[gaps] == 10, dtype=place))
    n = len(begins)
    ok = np.flatnonzero(line[:n - window + 1] == line[window - 1:])
    first = np.searchsorted(line, line[ok])
    out = np.zeros(len(ok), np.uint64)
    lo, hi = begins[ok], ends[ok + window - 1]
    # prefix sums of byte * base^position, block by block: hash = (P[hi] - P[lo]) / base^lo
    block = 1 << 20
    base, inverse = np.uint64(_BASE | 1), np.uint64(pow(_BASE | 1, -1, 1 << 64))
    at = 0
    while at < len(ok):
        origin = int(lo[at])
        stop = max(at + 1, int(np.searchsorted(hi, origin + block, "right")))
        stop = min(stop, len(ok))
        end = int(hi[stop - 1])
        span = end - origin
        power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(span, base))))
        back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(span, inverse))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw[origin:end].astype(np.uint64) + np.uint64(1)) * power[:span])))
        s = slice(at, stop)
        out[s] = mix64((total[hi[s] - origin] - total[lo[s] - origin]) * back[lo[s] - origin])
        at = stop
    return line[ok], ok - first, lo, hi, out


def repeated_windows(text: bytes, doc: np.ndarray, start: np.ndarray, window: int):
    """(string, window number) of every window of ``text`` that also starts
    earlier; string i lies at (doc[i], start[i])."""
    line, number, lo, hi, h = window_hashes(text, window)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twin = np.concatenate((same, [False])) | np.concatenate(([False], same))
    idx = order[twin]
    if not len(idx):
        return line[:0], number[:0]
    group = np.cumsum(np.concatenate(([True], h[idx[1:]] != h[idx[:-1]])))
    a, b = lo[idx].tolist(), hi[idx].tolist()
    g = group.tolist()
    if any(g[i] == g[i - 1] and text[a[i]:b[i]] != text[a[i - 1]:b[i - 1]] for i in range(1, len(a))):
        exact: dict[bytes, int] = {}  # two windows share a hash: group by their bytes
        group = np.array([exact.setdefault(text[x:y], len(exact)) for x, y in zip(a, b)])
    d, s = doc[line[idx]], start[line[idx]] + number[idx]
    by = np.lexsort((s, d, group))
    idx, d, s, group = idx[by], d[by], s[by], group[by]
    head = np.concatenate(([True], group[1:] != group[:-1]))
    first = np.maximum.accumulate(np.where(head, np.arange(len(idx)), 0))
    late = idx[(d != d[first]) | (s != s[first])]
    late.sort()
    return line[late], number[late]


def _bucket(window: int):
    """Reduce side: one bucket's rows to the runs of repeated windows."""

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        gone = [np.frombuffer(unpack(x), np.int64).reshape(4, -1) for x in table["gone"].to_pylist()]
        at = [np.frombuffer(unpack(x), np.int64).reshape(3, -1) for x in table["at"].to_pylist()]
        out, place = np.concatenate(gone, axis=1), np.concatenate(at, axis=1)
        if place.shape[1]:
            text = b"\n".join([unpack(w) for w, x in zip(table["words"].to_pylist(), at) if x.shape[1]])
            doc, th, start = place
            line, number = repeated_windows(text, doc, start, window)
            if len(line):
                head = np.concatenate(([True], (line[1:] != line[:-1]) | (number[1:] != number[:-1] + 1)))
                first = np.flatnonzero(head)
                size = np.diff(np.concatenate((first, [len(line)])))
                s = line[first]
                out = np.concatenate((out, np.stack((doc[s], th[s], start[s] + number[first], size))), axis=1)
        return pa.table(dict(zip(("_id", "_th", "first", "n"), out)))

    return run


def dealt(docs: DataFrame, window: int = WINDOW_WORDS) -> tuple[DataFrame, int]:
    """Rows of packed strings (bucket, words, at, gone) and the number of buckets."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-chars // BUCKET_CHARS))
    rows = short_batches(docs).select("_id", "_th", "text")
    held = rows.mapInArrow(_deal(window, buckets, count=True), "bucket long, n_words long, n_windows long").groupBy("bucket").agg(
        F.sum("n_words").alias("n_words"), F.sum("n_windows").alias("n_windows")).where(F.col("n_words") > BUCKET_WORDS).collect()
    hot = tuple(r["bucket"] for r in held)
    extra = -(-sum(r["n_windows"] for r in held) * window // max(1, BUCKET_WORDS // 4))
    packed = rows.mapInArrow(_deal(window, buckets, hot, extra), "bucket long, words binary, at binary, gone binary")
    return packed, buckets + extra


def repeated_runs(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(_id, _th, first, n): runs of ``n`` windows from word ``first`` that also
    start earlier, in smaller doc_id or in the same document.  ``docs`` is
    (_id, _th, text); _th tells rows that share an id apart."""
    packed, buckets = dealt(docs, window)
    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        _bucket(window), "_id long, _th long, first long, n long")


def _cover(window: int):
    def run(batches):
        for b in slices(batches):
            kept, n_words, n_removed = [], [], []
            for text, firsts, sizes in zip(*[b.column(i).to_pylist() for i in range(1, 4)]):
                words = split_words(text)
                total = len(words)
                if firsts:
                    edge = np.zeros(total + 1, np.int64)
                    first, size = np.array(firsts), np.array(sizes)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + size + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                n_words.append(total)
                n_removed.append(total - len(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                ["doc", "kept_text", "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(doc, kept_text, n_words, n_removed) for every row of ``docs``.

    ``doc`` holds the row's own columns.  A word goes if a window that covers
    it also starts earlier (smaller doc_id, or same document and earlier
    start); windows are judged on the input.  Null text has no words; a null
    doc_id counts as later than any other; rows that share a doc_id lie at the
    same place, so neither is earlier than the other.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce("doc_id", F.lit(_LAST_ID)).cast("long").alias("_id"),
                        F.xxhash64("text").alias("_th"), "text")
    runs = written(repeated_runs(keyed, window), "runs")
    per_doc = written(runs.groupBy("_id", "_th").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("sizes")), "runs-doc")
    joined = keyed.join(per_doc, ["_id", "_th"], "left").select("doc", "text", "firsts", "sizes")
    schema = keyed.select("doc").schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(_cover(window), schema)


def strip_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``.

    A text that loses words becomes its kept words joined by one space, and
    ``n_chars`` its new length; other texts stay as they are, and no row goes.
    """
    out = remove_repeats(docs, window)
    changed = F.col("n_removed") > 0
    cols = []
    for c in docs.columns:
        col = F.col("doc").getField(c)
        if c == "text":
            col = F.when(changed, F.col("kept_text")).otherwise(col)
        elif c == "n_chars":
            col = F.when(changed, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(col)
        cols.append(col.alias(c))
    return out.select(*cols)
