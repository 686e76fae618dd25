"""Severity grades by cumulative-link (proportional odds) ordinal regression.

A text is the set of its words and of their stems of several lengths, each
also as "held at least 2, 3 times" and "at least so many of 1000 words".  One
weight vector serves all grades; ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold_k - score).  The result carries the expected
grade and the probability of each grade or worse.  The vocabulary and the
weights come from a bounded sample of labelled rows, and the probability from
which a text counts as worse from a share of that sample that the weights never
saw; scoring reads every word of every text.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import slices, uniform, written

#: Bounds on the fit: labelled rows, bytes of a row's text, words of the vocabulary.
TRAIN_ROWS, TRAIN_TEXT_BYTES, VOCABULARY = 6000, 16384, 2000
#: A word counts if its share differs between grades by that many standard errors.
MIN_DOCS, MIN_Z = 4, 4.0
EPOCHS, BATCH, RATE, L2 = 30, 64, 0.05, 1e-4
#: Lengths of the stems; how often, and among 1000 words, one has to occur to count once more.
STEMS, TIMES, PER_MILLE = (3, 4, 5, 6), (2, 3), (5, 10, 20, 40)
#: Share of the drawn rows that is kept out of the fit, for the decision threshold.
HELD_OUT = 0.2
#: Words whose stems a scoring task remembers.
REMEMBERED = 200_000
_WORD = re.compile(r"[^\W_]+")


def stems(word: str) -> list[str]:
    """The word and its stems, ``abc~``, for the lengths below its own."""
    return [word, *[word[:n] + "~" for n in STEMS if len(word) > n]]


def features(text: str | None) -> set[str]:
    """Lower-cased words and stems of a text: ``x``; ``x_2`` if it occurs twice or
    more; ``x%5`` if it also makes up 5 or more of 1000 words."""
    words = Counter(_WORD.findall(text.lower())) if text else Counter()
    n = sum(words.values())
    held = Counter()
    for w, c in words.items():
        for x in stems(w):
            held[x] += c
    often = {f"{x}_{t}" for x, c in held.items() for t in TIMES if c >= t}
    return set(held) | often | {f"{x}%{q}" for x, c in held.items() if c > 1 for q in PER_MILLE if 1000 * c >= q * n}


def best_cut(p: np.ndarray, worse: np.ndarray) -> float:
    """Probability from which rows count as worse, by the largest F1; 0.5 without worse rows."""
    if not worse.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(worse[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + hit[-1])
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities cannot be parted
    at = int(f1.argmax())
    return float((p[at] + p[at + 1]) / 2 if at + 1 < len(p) else p[at])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Vocabulary (feature -> weight), ordered thresholds and the grades they part;
    ``cut`` is the probability from which a text counts as worse than the lowest."""

    def __init__(self, sets: list[set[str]], grades: np.ndarray, min_docs: int = MIN_DOCS, vocabulary: int = VOCABULARY, seed: int = 5):
        self.grades = sorted(set(np.asarray(grades).tolist()))
        self.weights: dict[str, float] = {}
        self.cut = 0.5
        share = np.array([np.mean(np.asarray(grades) <= g) for g in self.grades[:-1]])
        self.thresholds = np.log(share / (1 - share)) if len(self.grades) > 1 else np.zeros(0)
        if len(self.grades) > 1:
            self._fit(sets, np.searchsorted(self.grades, grades), min_docs, vocabulary, seed)
        # word or stem -> (times, per mille, weight); both bounds have to hold
        self._rules: dict[str, list[tuple[int, int, float]]] = {}
        for name, v in self.weights.items():
            x, times, mille = re.fullmatch(r"([^_%]+)(?:_(\d+))?(?:%(\d+))?", name).groups()
            self._rules.setdefault(x, []).append((int(times or (2 if mille else 1)), int(mille or 0), v))
        self._known: dict[str, list[str]] = {}

    def _fit(self, sets, y, min_docs, vocabulary, seed):
        # the words whose share differs most between the worse and the better half of the grades
        worse = y > 0
        held: dict[str, list[int]] = {}
        for s, w in zip(sets, worse):
            for word in s:
                held.setdefault(word, [0, 0])[int(w)] += 1
        n1, n0 = max(1, worse.sum()), max(1, (~worse).sum())
        all_docs = n1 + n0

        def z(word):
            c = held[word]
            p = sum(c) / all_docs
            return abs(c[1] / n1 - c[0] / n0) / np.sqrt(max(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))

        strong = {w: v for w in held if sum(held[w]) >= min_docs and (v := z(w)) >= MIN_Z}
        words = sorted(strong, key=lambda w: (-strong[w], w))[:vocabulary]
        column = {w: i for i, w in enumerate(words)}
        rows = [np.array(sorted(column[w] for w in s if w in column), np.int64) for s in sets]
        rng = np.random.default_rng(seed)
        w, cut = np.zeros(len(words)), self.thresholds.copy()
        k = len(cut)
        # thresholds stay ordered as first + sums of exp(gap)
        first, gap = cut[0], np.log(np.maximum(np.diff(cut), 1e-3))
        gw, gt = np.full(len(words), 1e-8), np.full(k, 1e-8)
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                pick = order[lo:lo + BATCH]
                size = np.array([len(rows[i]) for i in pick])
                cols = np.concatenate([rows[i] for i in pick]) if len(pick) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(pick)), size)
                score = np.bincount(owner, w[cols], len(pick))
                cut = first + np.concatenate(([0], np.cumsum(np.exp(gap))))
                below = np.hstack((np.zeros((len(pick), 1)), _sigmoid(cut - score[:, None]), np.ones((len(pick), 1))))
                at = np.arange(len(pick))
                upper, lower = below[at, y[pick] + 1], below[at, y[pick]]
                p = np.maximum(upper - lower, 1e-12)
                du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
                dscore = (du - dl) / len(pick)                       # of the negative log likelihood
                dcut = np.bincount(y[pick], -du / len(pick), k + 1)[:k] + np.bincount(y[pick], dl / len(pick), k + 1)[1:]
                g = np.bincount(cols, dscore[owner], len(words)) + L2 * w
                dfirst = dcut.sum()
                dgap = np.cumsum(dcut[::-1])[::-1][1:] * np.exp(gap)
                gw += g * g
                w -= RATE * g / np.sqrt(gw) * 4
                gt += np.concatenate(([dfirst], dgap)) ** 2
                step = RATE * np.concatenate(([dfirst], dgap)) / np.sqrt(gt) * 4
                first, gap = first - step[0], gap - step[1:]
        self.thresholds = first + np.concatenate(([0], np.cumsum(np.exp(gap))))
        self.weights = {x: float(v) for x, v in zip(words, w) if v}

    def score(self, text: str | None) -> float:
        words = Counter(_WORD.findall(text.lower())) if text else Counter()
        n = sum(words.values())
        held: dict[str, int] = {}
        if len(self._known) > REMEMBERED:
            self._known.clear()
        for w, c in words.items():
            known = self._known.get(w)
            if known is None:
                known = self._known[w] = [x for x in stems(w) if x in self._rules]
            for x in known:
                held[x] = held.get(x, 0) + c
        return float(sum(sorted(v for x, c in held.items() for times, mille, v in self._rules[x] if c >= times and 1000 * c >= mille * n)))

    def worse(self, sets: list[set[str]]) -> np.ndarray:
        """P(worse than the lowest grade) of sets of features."""
        if not len(self.thresholds):
            return np.zeros(len(sets))
        s = np.array([sum(sorted(filter(None, map(self.weights.get, x)))) for x in sets], np.float64)
        return 1 - _sigmoid(self.thresholds[0] - s)

    def at_least(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= g) for every text and every grade but the lowest."""
        s = np.array([self.score(t) for t in texts])
        return 1 - _sigmoid(self.thresholds[None, :] - s[:, None])


def fit(docs: DataFrame, grades: DataFrame, max_rows: int = TRAIN_ROWS, max_text_bytes: int = TRAIN_TEXT_BYTES) -> Model:
    """Model from ``grades`` (doc_id, grade) and the texts of ``docs``.

    At most about ``max_rows`` rows are drawn by a hash of the id; null ids and
    grades do not count, and a doc_id with several grades takes the worst.  The
    features are counted by the executors; the driver gets those that count.
    """
    known = (grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("_y")))
    n = known.count()
    drawn = known.where(uniform("doc_id", seed=11) < min(1.0, max_rows / max(1, n)))
    rows = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= max_text_bytes).select("doc_id", "text").join(drawn, "doc_id").dropDuplicates(["doc_id"])

    def sets(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(
                [sorted(features(t)) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], ["doc_id", "_y", "words"])

    every = written(rows.select(F.col("doc_id").cast("long"), "_y", "text").mapInArrow(sets, "doc_id long, _y int, words array<string>"), "features")
    first = every.groupBy(F.xxhash64("words")).agg(F.min("doc_id").alias("doc_id"))  # copies would pass for evidence
    once = every.join(first, "doc_id", "left_semi").withColumn("_out", uniform("doc_id", seed=12) < HELD_OUT)
    lowest, = once.where("NOT _out").agg(F.min("_y")).first()
    worse = F.col("_y") > F.lit(lowest)
    n1, n0 = once.where("NOT _out").agg(F.greatest(F.count_if(worse), F.lit(1)), F.greatest(F.count_if(~worse), F.lit(1))).first()
    held = once.where("NOT _out").select(worse.alias("_w"), F.explode("words").alias("w")).groupBy("w").agg(
        F.count_if("_w").alias("c1"), F.count_if(~F.col("_w")).alias("c0"))
    p = (F.col("c1") + F.col("c0")) / (n1 + n0)
    z = F.abs(F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    words = [r["w"] for r in held.where(F.col("c1") + F.col("c0") >= MIN_DOCS).withColumn("z", z).where(F.col("z") >= MIN_Z)
             .orderBy(F.desc("z"), "w").limit(VOCABULARY).collect()]
    strong = F.array_intersect("words", F.from_json(F.lit(json.dumps(words)), "array<string>"))
    got = sorted(once.select("doc_id", "_y", "_out", strong.alias("words")).collect(), key=lambda r: r["doc_id"])
    fitted, out = [r for r in got if not r["_out"]], [r for r in got if r["_out"]]
    model = Model([set(r["words"]) for r in fitted], np.array([r["_y"] for r in fitted], np.int64))
    if model.weights and out:
        model.cut = best_cut(model.worse([set(r["words"]) for r in out]), np.array([r["_y"] for r in out]) > lowest)
    return model


def severity(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns, ``severity`` (expected grade), ``grade`` (the most
    probable; ties: the lower) and ``p_worse`` (probability of any grade but the
    lowest) for every row.  Null text is the empty text; without learned grades
    all is the one grade known, or 0."""
    grades = np.array(model.grades or [0], np.float64)

    def run(batches):
        for b in slices(batches):
            more = model.at_least(b.column(0).to_pylist())
            exact = np.hstack((np.ones((len(more), 1)), more)) - np.hstack((more, np.zeros((len(more), 1))))
            worse = more[:, 0] if more.shape[1] else np.zeros(len(more))
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(exact @ grades), pa.array(grades[exact.argmax(axis=1)].astype(np.int32)), pa.array(worse)],
                ["doc", "severity", "grade", "p_worse"])

    src = docs.select("text", F.struct(*keep).alias("doc"))
    out = src.mapInArrow(run, src.select("doc").schema.add("severity", "double").add("grade", "integer").add("p_worse", "double"))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in keep], "severity", "grade", "p_worse")
