"""Language identification by a string kernel.

Two texts are compared by the blended-spectrum presence kernel: the number of
byte n-grams (n = 1 to 3) that both hold, normalised to at most one.  A
Nystroem map of ``LANDMARKS`` labelled texts stands for the kernel; the
n-grams that occur in a landmark are its alphabet.  One-versus-rest kernel
ridge regression gives a weight for each landmark and language.  Scoring a
batch is two matrix products: presence x landmarks, then kernel x weights.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import has_letter, slices, uniform

MAX_GRAM = 3
#: Bounds on the fit: rows of each language, bytes of a row's text, landmarks and alphabet.
TRAIN_ROWS, TRAIN_TEXT_BYTES = 600, 16384
LANDMARKS, GRAMS = 128, 8192
RIDGE = 1e-3
UNKNOWN = "und"
#: Texts and bytes in one product.
BATCH_TEXTS, BATCH_BYTES = 256, 1 << 20


def _lower(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass") if text else b""


def gram_codes(raw: np.ndarray, n: int) -> np.ndarray:
    """A number for the n bytes from every position; n-grams of different n differ."""
    code = raw[:len(raw) - n + 1].astype(np.int32) + 1
    for i in range(1, n):
        code = code * 257 + raw[i:len(raw) - n + 1 + i] + 1
    return code


def gram_set(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    return np.unique(np.concatenate([gram_codes(raw, n) for n in range(1, MAX_GRAM + 1) if len(raw) >= n] or [np.zeros(0, np.int32)]))


class Kernel:
    """Presence vectors over the landmarks' n-grams, and the kernel with them."""

    def __init__(self, landmarks: list[bytes], max_grams: int = GRAMS):
        sets = [gram_set(t) for t in landmarks]
        grams, held = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int32), return_counts=True)
        keep = np.sort(np.lexsort((grams, -held))[:max_grams])
        self.grams = grams[keep]
        self.marks = np.zeros((len(sets), len(self.grams)), np.float32)
        for row, s in zip(self.marks, sets):
            row[np.flatnonzero(np.isin(self.grams, s))] = 1
        self.marks /= np.sqrt(np.maximum(1, self.marks.sum(axis=1, keepdims=True)))

    @functools.cached_property
    def column(self) -> np.ndarray:
        """Column of every n-gram's number; those outside the alphabet share the last."""
        out = np.full(258 ** MAX_GRAM, len(self.grams), np.int16)
        out[self.grams] = np.arange(len(self.grams))
        return out

    def presence(self, texts: list[bytes]) -> np.ndarray:
        column = self.column
        x = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        flat = x.ravel()
        for row, text in enumerate(texts):
            raw = np.frombuffer(text, np.uint8)
            for n in range(1, MAX_GRAM + 1):
                if len(raw) >= n:
                    flat[column[gram_codes(raw, n)].astype(np.int64) + row * x.shape[1]] = 1
        return x[:, :-1]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        x = self.presence(texts)
        return (x @ self.marks.T) / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))

    def __getstate__(self):
        return {"grams": self.grams, "marks": self.marks}


class Model:
    """Kernel, ridge weights (landmarks x languages) and the languages."""

    def __init__(self, texts: list[bytes], langs: list[str], landmarks: int = LANDMARKS):
        self.langs = sorted(set(langs))
        by_lang = [[i for i, x in enumerate(langs) if x == lang] for lang in self.langs]
        each = max(1, landmarks // max(1, len(self.langs)))
        self.kernel = Kernel([texts[i] for ids in by_lang for i in ids[:each]])
        y = np.array([[x == lang for lang in self.langs] for x in langs], np.float64).reshape(len(langs), len(self.langs))
        phi = self.features(texts)
        # rows weigh so that every language counts alike
        weight = 1 / np.maximum(1, y.sum(axis=0))[y.argmax(axis=1)] if len(langs) else np.zeros(0)
        gram = (phi * weight[:, None]).T @ phi
        land = self.kernel.marks.astype(np.float64) @ self.kernel.marks.T.astype(np.float64)
        land = np.block([[land, np.zeros((len(land), 1))], [np.zeros((1, len(land) + 1))]])
        self.weights = np.linalg.solve(gram + RIDGE * (land + 1e-4 * np.eye(len(land))), (phi * weight[:, None]).T @ y).astype(np.float32)

    def features(self, texts: list[bytes]) -> np.ndarray:
        parts = [self.kernel(texts[i:i + BATCH_TEXTS]) for i in range(0, len(texts), BATCH_TEXTS)]
        k = np.concatenate(parts) if parts else np.zeros((0, len(self.kernel.marks)), np.float32)
        return np.hstack((k, np.ones((len(k), 1)))).astype(np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, score
        todo = [i for i, t in enumerate(texts) if has_letter(t)]
        while todo:
            n, held = 0, 0
            while n < len(todo) and n < BATCH_TEXTS and (not n or held + len(texts[todo[n]]) <= BATCH_BYTES):
                held += len(texts[todo[n]])
                n += 1
            rows, todo = todo[:n], todo[n:]
            k = self.kernel([_lower(texts[i]) for i in rows])
            out = k @ self.weights[:-1] + self.weights[-1]
            best = out.argmax(axis=1)
            for i, b, s in zip(rows, best.tolist(), np.clip(out.max(axis=1), 0, 1).tolist()):
                lang[i], score[i] = self.langs[b], s
        return lang, score


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, max_text_bytes: int = TRAIN_TEXT_BYTES, landmarks: int = LANDMARKS) -> Model:
    """Model from (doc_id, text, lang): at most ``rows`` texts of each language,
    of at most ``max_text_bytes`` bytes, drawn by a hash of id and text below a
    threshold that follows from the language's count.  Rows with a null language
    or a text without a word do not count, repeated rows count once."""
    pool = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") <= max_text_bytes) & (F.octet_length("text") > 0))
    size = {r[0]: r[1] for r in pool.groupBy("lang").agg(F.count("*")).collect()}
    # what is drawn of a language holds its ``rows`` smallest hashes but for a chance of one in a billion
    share = [F.when(F.col("lang") == lang, F.lit((rows + 6 * rows ** 0.5 + 20) / n)) for lang, n in size.items()]
    drawn = pool.select("doc_id", "lang", "text", uniform("doc_id", "text", seed=3).alias("u")).where(F.col("u") < F.coalesce(*share, F.lit(0.0)))
    found: dict[str, list] = {lang: [] for lang in size}
    for r in drawn.distinct().collect():
        found[r["lang"]].append(r)
    kept = [r for of in found.values() for r in sorted(of, key=lambda r: (r["u"], r["text"]))[:rows] if has_letter(r["text"])]
    kept.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["lang"], r["text"]))
    return Model([_lower(r["text"]) for r in kept], [r["lang"] for r in kept], landmarks)


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1) for every row of ``docs``.

    A null text or one without a letter is ``und`` with score 0, and so is
    everything when nothing could be learned.  Ties go to the language first
    in alphabetical order.  Repeated rows are scored each, texts are whole
    however long, and an empty table gives no row.
    """
    def run(batches):
        for b in slices(batches):
            lang, score = model.predict(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc", "lang_pred", "score"])

    src = docs.select("text", F.struct(*keep).alias("doc"))
    out = src.mapInArrow(run, src.select("doc").schema.add("lang_pred", "string").add("score", "double"))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in keep], "lang_pred", "score")
