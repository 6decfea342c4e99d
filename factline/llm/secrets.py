"""Secrets by two character Markov models.

Base patterns find labelled samples of random strings; long words of letters alone are samples of
ordinary identifiers. One model of character transitions is counted from each over the whole corpus,
and a candidate is a secret if the log-likelihood ratio of the two says so. DataFrame expressions
only; the models are one number a pair of characters.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.functions.folds import bind
from factline.llm import spans as S
from factline.sources import scratch

KINDS = ("assign", "access", "hex", "markov")

# The base patterns; only letters of the key words are taken in either case.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGNED = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Nats by which "random" must win: in all, and on average over the transitions.
TOTAL, MEAN = 12.0, 0.8
BACK_OFF = 5.0


def base(text) -> F.Column:
    """All base spans of a text that is not null, sorted by start, then kind."""
    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    assign = F.filter(S.matches(text, ASSIGN, sign), lambda x: F.length(F.regexp_extract(x["m"], ASSIGNED, 1)) >= 12)
    access = F.filter(S.matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda x: x["e"] - x["s"] >= 18)
    hexes = S.matches(text, HEX)
    return F.array_sort(F.concat(*[S.of_kind(x, k) for k, x in enumerate((assign, access, hexes))]))


def transitions(words: DataFrame) -> DataFrame:
    """(random, pair, n): how often each pair of neighbouring characters occurs in (random, m)."""
    pairs = bind(F.split("m", ""), lambda c: F.transform(F.sequence(F.lit(1), F.length("m") - 1), lambda i: F.concat(F.get(c, i - 1), F.get(c, i))))
    return words.where(F.length("m") > 1).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()


def ratios(counts: list) -> dict[str, float]:
    """Log-likelihood ratio, random over ordinary, of every pair of characters of the alphabet."""
    size = len(ALPHABET)
    n = {True: {}, False: {}}
    for r in counts:
        if all(c in ALPHABET for c in r.pair):
            n[r.random][r.pair] = r["count"]
    before = {k: {a: sum(v.get(a + b, 0) for b in ALPHABET) for a in ALPHABET} for k, v in n.items()}
    ends = {k: {b: sum(v.get(a + b, 0) for a in ALPHABET) for b in ALPHABET} for k, v in n.items()}
    # A pair's chance falls back on how common its second character is.
    alone = {k: {b: (ends[k][b] + 0.5) / (sum(ends[k].values()) + 0.5 * size) for b in ALPHABET} for k in n}
    after = lambda k, a, b: (n[k].get(a + b, 0) + BACK_OFF * alone[k][b]) / (before[k][a] + BACK_OFF)
    return {a + b: math.log(after(True, a, b) / after(False, a, b)) for a in ALPHABET for b in ALPHABET}


def ratio(m, table: dict[str, float]) -> F.Column:
    """Summed log-likelihood ratio of a string's transitions."""
    size = len(ALPHABET)
    values = F.split(F.lit(",".join(f"{table[a + b]:.6f}" for a in ALPHABET for b in ALPHABET)), ",").cast("array<double>")
    places = F.transform(F.split(m, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    total = bind(places, lambda p: F.aggregate(F.sequence(F.lit(1), F.length(m) - 1), F.lit(0.0), lambda acc, i: acc + F.get(values, size * F.get(p, i - 1) + F.get(p, i))))
    return F.when(F.length(m) > 1, total).otherwise(0.0)


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row of `docs`: arrays of (s, k, e), k an index of KINDS.

    `spans` holds `base` and the candidates that the models call random; those never overlap base
    spans. Null and empty texts have none; without samples of both sorts nothing is added. Repeated
    rows stay and count as often. Other columns are ignored. Texts are read once and don't move.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", t.alias("t")).withColumn("base", base(F.col("t")))
    rows = rows.withColumn("may", S.free(S.of_kind(S.matches(F.col("t"), CANDIDATE), 3), F.col("base")))
    rows = scratch.written(rows.select("doc_id", "base", "may"), "candidates")
    value = F.transform("base", lambda x: F.when(x["k"] == 0, F.regexp_extract(x["m"], ASSIGNED, 1)).otherwise(x["m"]))
    random = rows.select(F.lit(True).alias("random"), F.explode(value).alias("m"))
    plain = rows.select(F.explode(F.transform("may", lambda x: x["m"])).alias("m")).where(F.col("m").rlike("^[A-Za-z][a-z]*$"))
    counts = transitions(random.union(plain.select(F.lit(False).alias("random"), "m"))).collect()  # two numbers a pair of characters at most
    place = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    own = F.transform("base", place)
    if {r.random for r in counts} != {True, False}:
        return rows.select("doc_id", own.alias("base"), own.alias("spans"))
    table = ratios(counts)
    won = lambda x: bind(ratio(x["m"], table), lambda r: (r >= TOTAL) & (r >= MEAN * (x["e"] - x["s"] - 1)))
    more = F.transform(F.filter("may", won), place)
    return rows.select("doc_id", own.alias("base"), F.array_sort(F.concat(own, more)).alias("spans"))
