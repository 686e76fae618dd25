"""Mixing sources to target weights through soft domain membership.

A classifier learned from a labelled table (naive Bayes over the presence of
marker words; words are lower-cased runs of letters, marks and digits) gives every document posteriors over the domains.  Document
rates r >= 0 are fitted so that the expected tokens of each domain,
``sum tokens * posterior * rate``, match targets: least squares by projected
gradient, each domain's step scaled by its size.  The rates start at the same value for
all; a step moves each along the gradient of the squared residuals, and what
falls below zero is set to zero.  As the gradient of a document's rate (in
the norm that counts a document by its tokens) depends on its posteriors
alone, the accumulated step is one number for each domain, documents with
equal posteriors are summed up beforehand, and an iteration is one small
aggregation.

Everything on the main path is DataFrame functions; the driver holds numbers
for domains and markers only.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import WORD_GAP, uniform, written

#: Bounds on the fit: labelled rows, characters of a row's text, marker words for each domain.
TRAIN_ROWS, TRAIN_TEXT_CHARS, MARKERS = 2000, 16384, 60
#: Rows of its domain that hold a marker, at least.
MIN_DOCS = 5
TOLERANCE, MAX_STEPS = 1e-6, 500
#: Share of all tokens by which a domain may miss a stated weight.
MAX_RESIDUAL = 0.01
_SPACES = "\t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Domains:
    """names; marker words; log prior, and for each marker and domain the log odds
    it adds when present or absent."""
    names: tuple[str, ...]
    markers: tuple[str, ...]
    prior: tuple[float, ...]
    present: tuple[tuple[float, ...], ...]
    absent: tuple[tuple[float, ...], ...]


def _padded(text: Column) -> Column:
    """The text with every word between single spaces."""
    return F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), _SPACES, " " * len(_SPACES)), F.lit(" "))


def _marker_words(text: Column) -> Column:
    """The lower-cased words of a text without punctuation (an empty one may stand at the ends)."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")


def fit_domains(labelled: DataFrame, max_rows: int = TRAIN_ROWS, markers: int = MARKERS) -> Domains:
    """Classifier from ``labelled`` (doc_id, text, domain): at most about
    ``max_rows`` rows drawn by a hash of the id, of at most ``TRAIN_TEXT_CHARS``
    characters.  Null domains do not count.  Markers are, for every domain, the
    words whose share of documents exceeds that of the other domains most."""
    known = labelled.where(F.col("domain").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) <= TRAIN_TEXT_CHARS))
    n = known.count()
    rows = written(known.where(uniform("doc_id", seed=21) < min(1.0, max_rows / max(1, n)))
                   .select("doc_id", "text", F.col("domain").cast("string").alias("domain")), "labelled")
    size = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    names = tuple(sorted(size))
    if not names:
        return Domains((), (), (), (), ())
    total = sum(size.values())
    words = rows.select("domain", F.explode_outer(F.array_distinct(_marker_words(F.col("text")))).alias("w")).where("w <> ''")
    held = words.groupBy("w", "domain").agg(F.count("*").alias("n"))
    wide = written(held.groupBy("w").agg(*[F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, d in enumerate(names)]), "marker-words")
    best: dict[str, tuple[int, ...]] = {}
    for i, d in enumerate(names):
        others = sum((F.col(f"n{j}") for j in range(len(names)) if j != i), F.lit(0))
        gain = F.col(f"n{i}") / size[d] - others / max(1, total - size[d])
        for r in wide.where((gain > 0) & (F.col(f"n{i}") >= MIN_DOCS)).orderBy(gain.desc(), "w").limit(markers).collect():
            best[r["w"]] = tuple(r[f"n{j}"] for j in range(len(names)))
    marks = tuple(sorted(best))
    share = [[(best[w][j] + 0.5) / (size[d] + 1) for j, d in enumerate(names)] for w in marks]
    return Domains(names, marks, tuple(math.log(size[d] / total) for d in names),
                   tuple(tuple(math.log(p) for p in row) for row in share),
                   tuple(tuple(math.log(1 - p) for p in row) for row in share))


def posteriors(docs: DataFrame, model: Domains, *keep: str) -> DataFrame:
    """``keep`` columns, ``n_tokens`` (words) and ``posterior`` (array by domain name)."""
    tokens = F.when(F.btrim(F.col("_text"), F.lit(" ")) == "", F.lit(0)).otherwise(F.size(F.split(F.btrim(F.col("_text"), F.lit(" ")), WORD_GAP)))
    marks = F.from_json(F.lit(json.dumps(model.markers)), "array<string>")
    # in the order of the markers, so that equal sets add up to equal scores
    found = F.array_intersect(marks, _marker_words(F.col("text")))
    base = docs.select(*keep, "text", _padded(F.col("text")).alias("_text")).select(*keep, tokens.cast("long").alias("n_tokens"), found.alias("_found"))
    # what a marker adds to each domain's score when present instead of absent
    adds = F.from_json(F.lit(json.dumps({w: [x - y for x, y in zip(p, a)] for w, p, a in zip(model.markers, model.present, model.absent)})),
                       "map<string,array<double>>")
    start = [prior + sum(a[d] for a in model.absent) for d, prior in enumerate(model.prior)]
    scored = base.select(*keep, "n_tokens", F.aggregate("_found", F.array(*[F.lit(float(x)) for x in start]),
                                                        lambda acc, w: F.zip_with(acc, F.element_at(adds, w), lambda x, y: x + y)).alias("_s"))
    shifted = scored.withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.array_max("_s"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    # rounded, so that documents of equal markers stay equal when summed up
    return shifted.withColumn("_t", total).select(*keep, "n_tokens", F.transform("_e", lambda x: F.round(x / F.col("_t"), 9)).alias("posterior"))


def _rate(steps: list[float], start: float, least: float = 0.0) -> Column:
    move = sum((F.lit(float(c)) * F.col("posterior")[i] for i, c in enumerate(steps)), F.lit(0.0))
    return F.greatest(F.lit(float(least)), F.lit(float(start)) - move)


def fit_rates(groups: DataFrame, targets: list[float], start: float = 1.0, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS,
              least: float = 0.0):
    """(steps, residual): one accumulated gradient for each domain; rates follow
    from it by ``_rate`` and none is below ``least``.  The gradients are summed up
    and the sum is projected, which is how rates of one posterior stay one number.  ``groups`` is (posterior, n_tokens), equal posteriors
    summed up.  ``residual`` is the largest |expected - target| over the total."""
    k = len(targets)
    posterior = F.col("posterior")
    held = groups.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * posterior[i]) for i in range(k)]).first()
    total, size = held[0] or 0, [x or 0.0 for x in held[1:]]
    steps = [0.0] * k
    if not total:
        return steps, 0.0
    residual = math.inf
    for _ in range(max_steps):
        rate = _rate(steps, start, least)
        got = groups.agg(*[F.sum(F.col("n_tokens") * posterior[i] * rate) for i in range(k)]).first()
        gap = [got[i] - targets[i] for i in range(k)]
        residual = max(map(abs, gap)) / total
        if residual <= tolerance:
            break
        # posteriors sum to one, so a domain's own total bounds the curvature along it
        steps = [c + g / max(s, 1e-9 * total) for c, g, s in zip(steps, gap, size)]
    return steps, residual


def smoothed(totals: list[float], power: float = 0.7) -> list[float]:
    """Target weights that lift small domains: shares to ``power``, summing to one."""
    grown = [max(t, 0.0) ** power for t in totals]
    return [g / (sum(grown) or 1) for g in grown]


def mix(docs: DataFrame, model: Domains, weights: dict[str, float] | None = None, *keep: str) -> DataFrame:
    """``keep`` columns, n_tokens, posterior, rate, copies, for every row of ``docs``.

    ``weights`` are the domains' target shares (default: their expected shares
    to the power 0.7, summing to one).  The budget lets the domain that is most
    plentiful against its target keep rate one; with the default weights it grows
    until no document's rate is below one; where the domains hardly part, rates
    below one are set to one and a warning tells what is missed.  So default weights
    repeat documents but never drop one.  Stated weights that stay missed by more
    than ``MAX_RESIDUAL`` raise an error.
    ``copies`` realises the rate: its whole part, and one more for that share of
    the documents that a hash of the doc_id picks.  Null text has no tokens and
    no word, hence the prior's posteriors.  Without domains every rate is one.
    """
    if not model.names:
        one = docs.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"))
        return one.withColumn("copies", F.lit(1))
    seen = written(posteriors(docs.select("text", F.col("doc_id").alias("_id"), F.struct(*keep).alias("_k")), model, "_id", "_k"), "posteriors")
    groups = written(seen.groupBy("posterior").agg(F.sum("n_tokens").alias("n_tokens")), "domains")
    now = groups.agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[i]) for i in range(len(model.names))]).first()
    now = [x or 0.0 for x in now]
    share = [weights.get(d, 0.0) for d in model.names] if weights else smoothed(now)
    budget = max([t / w for t, w in zip(now, share) if w > 0] or [0.0])
    steps, residual = fit_rates(groups, [w * budget for w in share])
    start, least = 1.0, 0.0
    if weights is None:
        least = 1.0
        lowest = groups.agg(F.min(_rate(steps, start))).first()[0] or 0.0
        if lowest > 0.5:  # rates are linear in the budget: no document falls below one but for the last digit
            start, steps = start / lowest, [c / lowest for c in steps]
        else:  # the domains hardly part: the nearest totals of rates that keep every document
            steps, residual = fit_rates(groups, [w * budget for w in share], least=least)
            if residual > MAX_RESIDUAL:
                warnings.warn(f"default weights missed by {residual:.3f} of all tokens, as every document is kept", stacklevel=2)
    elif residual > MAX_RESIDUAL:
        raise ValueError(f"the weights are missed by {residual:.3f} of all tokens: the documents' posteriors cannot meet them")
    rate = _rate(steps, start, least)
    out = seen.select("_id", F.col("_k.*"), "n_tokens", "posterior", rate.alias("rate"))
    whole = F.floor("rate")
    more = uniform("_id", seed=22) < F.col("rate") - whole
    return out.withColumn("copies", (whole + F.when(more, 1).otherwise(0)).cast("int")).drop("_id")


def resample(docs: DataFrame, model: Domains, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with every row repeated ``copies`` times (none for 0)."""
    out = mix(docs.withColumn("_row", F.struct(*docs.columns)), model, weights, "_row")
    return out.where("copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
