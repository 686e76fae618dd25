"""Quality scores from a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and read in overlapping chunks that cover
all of it: a chunk holds ``CHUNK`` filter positions, and its last filters
reach into the next chunk's bytes.  Every learned filter is max-pooled over
each chunk; the largest and the mean over the chunks go into one logistic
unit.  The network is trained here, by Adam on the log loss, from a bounded
sample of labelled rows; scoring reads every byte of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import short_batches, slices, uniform

WIDTH, STRIDE, CHUNK = 8, 2, 128
EMBED, FILTERS = 4, 24
#: Bounds on the fit: labelled rows, and bytes of the longest text among them.
TRAIN_ROWS, TRAIN_TEXT_BYTES = 3000, 16384
EPOCHS, BATCH, RATE = 14, 32, 0.01
#: Padded bytes that are scored at once.
BLOCK_BYTES = 1 << 18
_SPAN = CHUNK * STRIDE


def layout(texts: list[bytes]):
    """One buffer of all texts, each padded to whole chunks and at least a filter
    beyond its end; the texts' numbers of chunks; which positions are real."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    chunks = -(-(size + WIDTH) // _SPAN)
    at = np.cumsum(chunks) - chunks
    buf = np.zeros(int(chunks.sum()) * _SPAN + WIDTH, np.uint8)
    for t, a in zip(texts, (at * _SPAN).tolist()):
        buf[a:a + len(t)] = np.frombuffer(t, np.uint8)
    real = np.maximum(1, -(-(size - WIDTH) // STRIDE) + 1)
    place = np.arange(int(chunks.sum()) * CHUNK) - np.repeat(at * CHUNK, chunks * CHUNK)
    return buf, chunks, at, place < np.repeat(real, chunks * CHUNK)


def windows(buf: np.ndarray, embed: np.ndarray) -> np.ndarray:
    e = embed[buf]
    n = (len(buf) - WIDTH) // STRIDE
    step = e.strides
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(
        e, (n, WIDTH * embed.shape[1]), (STRIDE * step[0], step[1])))


def forward(net: dict, texts: list[bytes]):
    buf, chunks, at, real = layout(texts)
    x = windows(buf, net["E"])
    act = np.maximum(x @ net["W"].T + net["b"], 0)
    act[~real] = 0
    cube = act.reshape(-1, CHUNK, act.shape[1])
    pooled = cube.max(axis=1)
    top = np.maximum.reduceat(pooled, at, axis=0)
    mean = np.add.reduceat(pooled, at, axis=0) / chunks[:, None].astype(np.float32)
    doc = np.concatenate((top, mean), axis=1)
    return doc @ net["u"] + net["c"], (buf, chunks, at, x, cube, pooled, top, doc)


def probability(net: dict, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text, block by block."""
    out, lo = [], 0
    size = [len(t) + _SPAN for t in texts]
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + size[hi] <= BLOCK_BYTES):
            held += size[hi]
            hi += 1
        if held > 4 * BLOCK_BYTES:  # one long text: pool it piece by piece
            out.append(_long(net, texts[lo]))
        else:
            out.append(forward(net, texts[lo:hi])[0])
        lo = hi
    z = np.concatenate(out) if out else np.zeros(0, np.float32)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _long(net: dict, text: bytes) -> np.ndarray:
    """The logit of one long text; pieces of whole chunks overlap by a filter."""
    top, total, count = 0, 0, 0
    piece = BLOCK_BYTES // _SPAN * _SPAN
    for lo in range(0, len(text) + WIDTH, piece):
        part = text[lo:lo + piece + WIDTH - STRIDE] if lo + piece < len(text) + WIDTH else text[lo:]
        pooled = forward(net, [part])[1][5]
        pooled = pooled[:piece // _SPAN] if lo + piece < len(text) + WIDTH else pooled
        top, total, count = np.maximum(top, pooled.max(axis=0)), total + pooled.sum(axis=0), count + len(pooled)
    return np.array([np.concatenate((top, total / count)) @ net["u"] + net["c"]], np.float32)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> dict:
    """Fit the network; with one class only (or no rows) it predicts that class's share."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = {"E": rng.normal(0, .5, (256, EMBED)).astype(f32), "W": rng.normal(0, .25, (FILTERS, WIDTH * EMBED)).astype(f32),
           "b": np.zeros(FILTERS, f32), "u": rng.normal(0, .1, 2 * FILTERS).astype(f32), "c": f32(0)}
    y = np.asarray(labels, f32)
    if not len(y) or y.min() == y.max():
        net["u"][:] = 0
        net["c"] = f32(0 if not len(y) else (4 if y[0] else -4))
        return net
    net["c"] = f32(np.log(y.mean() / (1 - y.mean())))
    m, v, t = {k: 0 for k in net}, {k: 0 for k in net}, 0
    steps = EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            pick = order[lo:lo + BATCH]
            z, (buf, chunks, at, x, cube, pooled, top, doc) = forward(net, [texts[i] for i in pick])
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            ddoc = dz[:, None] * net["u"]
            owner = np.repeat(np.arange(len(pick)), chunks)
            is_top = pooled == top[owner]
            ties = np.add.reduceat(is_top.astype(f32), at, axis=0)
            dpool = ddoc[owner, FILTERS:] / chunks[owner, None] + is_top * (ddoc[:, :FILTERS] / ties)[owner]
            dpool *= pooled > 0
            pos = cube.argmax(axis=1) + np.arange(len(pooled))[:, None] * CHUNK
            seen = x[pos]                                          # chunk, filter, window
            dx = (dpool[:, :, None] * net["W"]).reshape(-1, EMBED)
            at_byte = buf[(pos[:, :, None] * STRIDE + np.arange(WIDTH)).ravel()]
            grad = {"u": dz @ doc, "c": dz.sum(), "b": dpool.sum(axis=0), "W": np.einsum("cf,cfk->fk", dpool, seen),
                    "E": np.stack([np.bincount(at_byte, dx[:, k], 256) for k in range(EMBED)], axis=1)}
            t += 1
            rate = RATE * (1 - t / (steps + 1)) * np.sqrt(1 - .999 ** t) / (1 - .9 ** t)
            for k, g in grad.items():
                m[k] = .9 * m[k] + .1 * g
                v[k] = .999 * v[k] + .001 * g * g
                net[k] = (net[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(f32)
    return net


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS,
        max_text_bytes: int = TRAIN_TEXT_BYTES) -> dict:
    """Network from at most about ``max_rows`` labelled rows whose text has at
    most ``max_text_bytes`` bytes, drawn by a hash of the id.

    ``labels`` is (doc_id, <label>); null ids and labels do not count, and a
    doc_id with several labels takes the smallest.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
             .groupBy("doc_id").agg(F.min(label).cast("int").alias("_y")))
    n = known.count()
    drawn = known.where(uniform("doc_id", seed=8) < min(1.0, max_rows / max(1, n)))
    rows = (docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= max_text_bytes).select("doc_id", "text")
            .join(drawn, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "_y").collect())
    rows.sort()
    return train([_bytes(r["text"]) for r in rows], np.array([r["_y"] for r in rows]))


def scores(docs: DataFrame, net: dict, *keep: str) -> DataFrame:
    """``keep`` columns and ``score``, the probability of label 1; one row per row of
    ``docs``.  Null text scores as the empty text."""
    def run(batches):
        for b in slices(batches):
            p = probability(net, [_bytes(t) for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(p, pa.float64())], ["doc", "score"])

    src = short_batches(docs).select("text", F.struct(*keep).alias("doc"))
    out = src.mapInArrow(run, src.select("doc").schema.add("score", "double"))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in keep], "score")


def keep_good(docs: DataFrame, net: dict, threshold: float = 0.5) -> DataFrame:
    """Rows that score at least ``threshold``, with the columns of ``docs``."""
    def run(batches):
        for b in slices(batches):
            p = probability(net, [_bytes(t) for t in b.column(0).field("text").to_pylist()])
            yield b.filter(pa.array(p >= threshold))

    rows = short_batches(docs).select(F.struct(*docs.columns).alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")
