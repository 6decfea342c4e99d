"""Mixing to target weights by soft membership.

A classifier learned from the labelled table gives every document a posterior over domains; then
projected-gradient least squares finds one nonnegative rate a document, such that the expected
tokens of each domain match the targets. DataFrame expressions only; what comes to the driver is
one number a domain (and one a feature bin, when learning), whatever the number of documents.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import common as K
from factline.sources import scratch

log = logging.getLogger(__name__)

#: Weights of the change of rates against the misses, the first tried and the least.
SLACK = 1e-6, 1e-12
#: Wanted shares of tokens. A labelled document of quality 0 is junk, any other belongs to its language.
TARGETS = {"en": 0.58, "de": 0.14, "fr": 0.14, "es": 0.10, "junk": 0.04}
JUNK = "junk"
BINS = 12
#: Common words by language, for features only.
STOPS = {
    "en": ("the", "of", "and", "to", "is"),
    "de": ("der", "die", "und", "das", "ist"),
    "fr": ("le", "la", "et", "les", "est"),
    "es": ("que", "de", "los", "el", "y"),
}


N_FEATURES = 5 + len(STOPS)
WORK = ("_text", "_words", "_kinds", "_common", "bins", "post", "_l", "_e", "_copies")


def binned(rows: DataFrame) -> DataFrame:
    """Rows with `_text` (not null), with `_words` and `bins`: surface features of it, 0 to BINS - 1 each."""
    stops = sorted({w for some in STOPS.values() for w in some})
    rows = rows.withColumn("_words", F.split(F.trim("_text"), r"\s+")).withColumn("_kinds", F.array_distinct("_words"))
    rows = rows.withColumn("_common", F.array_intersect("_kinds", F.array(*map(F.lit, stops))))
    n, size = F.length("_text"), F.size("_words")
    top = F.lit(BINS - 1)
    share = lambda part, whole: F.least(F.floor(part / F.greatest(whole, F.lit(1)) * BINS), top)
    common = lambda own: F.size(F.filter("_common", lambda w: w.isin(*own)))
    marks = n - F.length(F.translate("_text", "#$%&*!@^~=|<>{}[]", ""))
    upper = n - F.length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    features = [
        F.least(F.floor(F.log2(size + 1)), top),
        share(F.size("_kinds"), size),
        share(marks * 4, n),
        share(upper * 4, n),
        F.least(F.floor(n / F.greatest(size, F.lit(1))), top),
        *[common(own) for own in STOPS.values()],
    ]
    return rows.withColumn("bins", F.array(*[F.coalesce(c.cast("int"), F.lit(0)) for c in features]))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_tokens, bins): a compact row per document; `bins` has one number a feature.

    A null text is empty. Tokens are words between white space.
    """
    rows = docs.select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    n = F.when(F.get("_words", F.lit(0)) == "", 0).otherwise(F.size("_words"))
    return binned(rows).select("doc_id", "lang", n.cast("long").alias("n_tokens"), "bins")


def learn(rows: DataFrame, labels: DataFrame, domains: tuple[str, ...] = tuple(TARGETS)) -> tuple[dict[str, float], dict[tuple[int, int], dict[str, float]]]:
    """Naive Bayes log-probabilities from all labelled documents: (prior, by feature and bin).

    A document whose labels disagree counts for each; labels of no known domain are ignored.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    pairs = rows.join(known, "doc_id").withColumn("domain", F.when(F.col("quality") == 0, JUNK).otherwise(F.col("lang")))
    pairs = pairs.where(F.col("domain").isin(*domains)).select("domain", F.posexplode("bins").alias("feature", "bin"))
    counts = pairs.groupBy("domain", "feature", "bin").count().collect()  # domains x features x BINS rows at most
    seen = {(r.domain, r.feature, r.bin): r["count"] for r in counts}
    totals = {d: sum(v for (x, f, _), v in seen.items() if x == d and f == 0) for d in domains}
    everything = sum(totals.values())
    prior = {d: math.log((totals[d] + 1) / (everything + len(domains))) for d in domains}
    given = {(f, b): {d: math.log((seen.get((d, f, b), 0) + 0.5) / (totals[d] + 0.5 * BINS)) for d in domains} for f in range(N_FEATURES) for b in range(BINS)}
    return prior, given


def posterior(rows: DataFrame, model) -> DataFrame:
    """`rows` with `post`, one probability a domain, in the order of the model's domains."""
    prior, given = model
    logs = []
    for d in prior:
        table = F.array(*[F.array(*[F.lit(given[f, b][d]) for b in range(BINS)]) for f in range(N_FEATURES)])
        terms = [F.get(F.get(table, F.lit(f)), F.get("bins", F.lit(f))) for f in range(N_FEATURES)]
        logs.append(sum(terms, F.lit(prior[d])))
    # Rounded, so that the sums below don't depend on the order of additions.
    rows = rows.withColumn("_l", F.array(*logs)).withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("post", F.transform("_e", lambda x: F.round(x / total, 4))).drop("_l", "_e")


@dataclass(frozen=True)
class Mixture:
    """A fitted mixture: the classifier, the multipliers of each step (one is enough), what was reached, and whether it's the targets."""

    model: tuple
    history: tuple[tuple[float, ...], ...]
    domains: dict[str, dict[str, float]]
    met: bool = True

    def rate(self) -> F.Column:
        """The rate of a row with `post`: a fold over the steps, each kept at 0 or above."""
        if not self.history:
            return F.lit(1.0)
        turns = F.array(*[F.array(*[F.lit(x) for x in e]) for e in self.history])
        pull = lambda e: sum((F.get("post", F.lit(i)) * F.get(e, F.lit(i)) for i in range(len(self.domains))), F.lit(0.0))
        return F.aggregate(turns, F.lit(1.0), lambda r, e: F.greatest(F.lit(0.0), r - pull(e)))


def fit(rows: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, tolerance: float = 1e-6) -> Mixture:
    """Fit the classifier and the rates on `described` rows.

    Least squares over the domains' misses, starting from the rate 1 for everyone, by projected
    gradient: a step against the gradient, then onto rate >= 0. Misses are whitened by the domains'
    Gram matrix, which makes 1 a safe step, and rates are scaled by length, so that a document's
    rate depends on its posterior only. Where rate >= 0 binds for nobody this step is the last.
    Otherwise the step itself is sought whose projection meets the targets, with the least change of
    rates: by active sets, a Newton step over the documents with a rate above 0, shortened where it gains
    nothing, until the misses are within `tolerance` or no step gains. Targets that can't be met give
    the least squares, `met` false and a warning. Each step is one aggregate over the distinct posteriors
    (or three).

    `total` is the number of tokens wanted; by default 1.05 times the least total at which every
    domain but junk is used whole. Without tokens every rate is 1. A domain that no document may
    belong to stays at 0 whatever its target.
    """
    import numpy as np

    model = learn(rows, labels, tuple(targets))
    names = list(targets)
    d = len(names)
    groups = posterior(rows, model).groupBy("post").agg(F.sum("n_tokens").alias("n")).where("n > 0")
    groups = scratch.written(groups.select("post", F.col("n").cast("double").alias("n")), "posteriors")
    p = [F.get("post", F.lit(i)) for i in range(d)]
    n = F.col("n")
    first = groups.agg(*[F.sum(n * c) for c in p], *[F.sum(n * a * b) for a in p for b in p]).first()
    have = np.array([float(x or 0) for x in first[:d]])
    if have.sum() <= 0:
        return Mixture(model, (), {k: {"target": 0.0, "reached": 0.0} for k in names})
    gram = np.array([float(x or 0) for x in first[d:]]).reshape(d, d)
    # Coordinates in which the Gram matrix is the identity; directions that no document has are left out.
    w, v = np.linalg.eigh(gram)
    white = v[:, w > 1e-9 * w.max()] / np.sqrt(w[w > 1e-9 * w.max()])
    least = [have[i] / targets[k] for i, k in enumerate(names) if k != JUNK and targets[k] > 0]
    want = np.array([targets[k] for k in names]) * (total or 1.05 * max(least or [have.sum()]))
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]

    def priced(slack, *at):
        """The dual objective at each of some multipliers, and the tokens and Gram matrix of rates above 0 at the first."""
        r = [Mixture(model, (tuple(map(float, x)),), {k: {} for k in names}).rate() for x in at]
        rows = groups.select("n", "post", *[c.alias(f"r{k}") for k, c in enumerate(r)])
        on = F.when(F.col("r0") > 0, n).otherwise(0.0)
        sums = [F.sum(n * F.col(f"r{k}") * F.col(f"r{k}")) for k in range(len(at))]
        x = np.array(rows.agg(*sums, *[F.sum(n * c * F.col("r0")) for c in p], *[F.sum(on * p[i] * p[j]) for i, j in pairs]).first(), float)
        active = np.zeros((d, d))
        for (i, j), y in zip(pairs, x[len(at) + d :]):
            active[i, j] = active[j, i] = y
        return [x[k] / 2 + y @ want + slack / 2 * (y @ gram @ y) for k, y in enumerate(at)], x[len(at) : len(at) + d], active

    if (np.abs(have - want) <= tolerance * want.sum()).all():
        return Mixture(model, (), {k: {"target": float(want[i]), "reached": float(have[i])} for i, k in enumerate(names)})
    size = lambda x: np.linalg.norm(white.T @ x) / np.linalg.norm(white.T @ want)
    at, slack, missed = white @ (white.T @ (have - want)), SLACK[0], np.inf
    (value,), reached, active = priced(slack, at)
    while not (met := bool((np.abs(reached - want) <= tolerance * want.sum()).all())):
        slope = want - reached + slack * gram @ at
        step = -white @ np.linalg.solve(white.T @ active @ white + slack * np.eye(white.shape[1]), white.T @ slope)
        good = [] if size(slope) <= 1e-9 else [1.0]
        if good:
            (after,), reached_after, active_after = priced(slack, at + step)
            # Near the end the objective's own rounding hides what is gained; the slope shows it.
            nearer = -slope @ step <= 1e-9 * abs(value) and size(want - reached_after + slack * gram @ (at + step)) <= size(slope) / 2
            if after > value + 1e-4 * (slope @ step) and not nearer:
                shares = [0.5**k for k in range(1, 31)]
                values, *_ = priced(slack, *[at + t * step for t in shares])
                good = [t for t, x in zip(shares, values) if x <= value + 1e-4 * t * (slope @ step)][:1]
                if good:
                    (after,), reached_after, active_after = priced(slack, at + good[0] * step)
        if good:
            at, value, reached, active = at + good[0] * step, after, reached_after, active_after
            continue
        if size(slope) > 1e-6:
            break
        # Settled. A smaller weight brings rates nearer, unless the targets can't be met: then these are the least squares.
        off = np.abs(reached - want).max()
        if slack <= SLACK[1] or off > 0.9 * missed:
            break
        value, slack, missed = value - 0.99 * slack / 2 * (at @ gram @ at), slack / 100, off
    if not met:
        log.warning("targets can't be met; tokens off in the nearest mixture: %s", dict(zip(names, (reached - want).tolist())))
    return Mixture(model, (tuple(map(float, at)),), {k: {"target": float(want[i]), "reached": float(reached[i])} for i, k in enumerate(names)}, met)


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None) -> tuple[DataFrame, Mixture]:
    """(rows, fitted mixture): for every row of `docs` doc_id, lang, n_tokens, bins, post and rate.

    Null ids can't be learned from but get a rate; repeated rows count each.
    """
    rows = scratch.written(described(docs), "described")
    m = fit(rows, labels, targets, total)
    return posterior(rows, m.model).withColumn("rate", m.rate()), m


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None) -> DataFrame:
    """`docs` drawn at the fitted rates: floor(rate) copies of a row, and one more with the rest's chance.

    The chance comes from a hash of id and text, so equal runs draw alike. Columns stay as they are;
    rates are applied where the text lies, without a join, and rows are written once with their number.
    """
    m = fit(scratch.written(described(docs), "described"), labels, targets, total)
    clash = {c: K.free_name(docs, f"kept{i}") for i, c in enumerate(docs.columns) if c.lower() in WORK}
    own = docs.withColumnsRenamed(clash).withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    own = posterior(binned(own).drop("_words", "_kinds", "_common"), m.model)
    chance = F.pmod(F.xxhash64("doc_id", "_text"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(m.rate() + chance).cast("int")
    # Written, so that no filter on the number of copies repeats the expressions behind it.
    own = scratch.written(own.withColumn("_copies", copies).drop("_text", "bins", "post"), "drawn")
    own = own.where("_copies > 0").withColumn("_copies", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
    return own.drop("_copies").withColumnsRenamed({v: k for k, v in clash.items()})
