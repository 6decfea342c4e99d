"""Personal data by bootstrapped contextual extraction.

Base patterns find seed entities. The words around them are lexical patterns; patterns and instances
form a graph. In turn, a pattern is scored by the share of its instances that are known for one kind,
and an instance that no base pattern matched by the best of its patterns. Patterns of enough support
and confidence then mark unseen identifiers in their contexts. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.functions.folds import bind
from factline.llm import spans as S
from factline.sources import scratch

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that no position is tried twice.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13}(?:[ -]?[0-9])*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"

#: A word with a digit or an at sign may be an identifier.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
EDGE = ".,;:!?()[]{}<>\"'"
MIN_CHARS = 6
#: Characters of a text that are looked at for one context, so that long texts cost no more for each.
PIECE = 512
MIN_SUPPORT = 3
CONFIDENCE = 0.6


def digits(m) -> F.Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number) -> F.Column:
    """Whether digits pass: from the right, every second is doubled and its digits are added."""
    n = F.length(number)
    digit = lambda i: F.ascii(F.substring(number, n - i, F.lit(1))) - 48
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def base(text) -> F.Column:
    """All base spans of a text that is not null, sorted by start, then kind."""
    email = S.matches(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(S.matches(text, IP), lambda x: x["m"].rlike(IP_PARTS))
    size = lambda x: F.length(digits(x["m"]))
    card = F.filter(S.matches(text, CARD), lambda x: F.when(size(x).between(14, 19), luhn(digits(x["m"]))).otherwise(False))
    phone = F.filter(S.matches(text, PHONE, F.contains(text, F.lit("+"))), lambda x: size(x).between(10, 15))
    return F.array_sort(F.concat(*[S.of_kind(x, k) for k, x in enumerate((email, ip, card, phone))]))


def candidates(text, known) -> F.Column:
    """Words that may be identifiers, without punctuation at their edges, outside the base spans."""
    found = S.of_kind(S.matches(text, CANDIDATE), -1)
    edge = F.lit(EDGE)

    def stripped(x):
        left = F.ltrim(x["m"], edge)
        m = F.rtrim(left, edge)
        s = x["s"] + F.length(x["m"]) - F.length(left)
        return F.struct(s.alias("s"), x["k"].alias("k"), (s + F.length(m)).alias("e"), m.alias("m"))

    return S.free(F.filter(F.transform(found, stripped), lambda x: x["e"] - x["s"] >= MIN_CHARS), known)


def in_context(text, found) -> F.Column:
    """Spans with their lexical patterns: the word before with the shape, and the two words before."""

    def look(pieces, x):
        # A context is shorter than a piece, so it lies in the piece where the span starts and the one before.
        i = F.floor(x["s"] / PIECE).cast("int")
        near = F.concat(F.coalesce(F.get(pieces, i - 1), F.lit("")), F.get(pieces, i))
        at = x["s"] - F.greatest(i - 1, F.lit(0)) * PIECE
        before = F.rtrim(F.translate(F.lower(F.substring(near, F.greatest(at - 79, F.lit(1)), F.least(at, F.lit(80)))), "\n\t\r", "   "))
        shape = F.regexp_replace(F.regexp_replace(x["m"], r"\p{L}+", "a"), "[0-9]", "9")
        one, two = F.substring_index(before, " ", -1), F.substring_index(before, " ", -2)
        patterns = F.array(F.xxhash64(F.lit(1), one, shape), F.xxhash64(F.lit(2), two))
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.xxhash64(F.lower(x["m"])).alias("inst"), patterns.alias("patterns"))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return bind(F.struct(cut.alias("pieces"), found.alias("found")), lambda own: F.transform(own["found"], lambda x: look(own["pieces"], x)))


def bootstrap(graph: DataFrame, min_support: int = MIN_SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(inst, k): kinds of instances that no base pattern knows, from edges (pattern, inst, k or -1).

    Each round: a pattern's score for a kind is the sum of its instances' scores over their number; it
    is kept if instances of one kind known for sure support it at least `min_support` times, or ones learned
    before do, and the score reaches `confidence`. Then unknown instances have the score of their best
    pattern. What was learned stays and its score never falls, so rounds end: the first that learns no new
    instance is the last. Ties go to the first kind.
    """
    edges = scratch.written(graph.groupBy("pattern", "inst").agg(F.max("k").alias("k")), "graph")
    sure = edges.where("k >= 0").groupBy("inst").agg(F.min("k").alias("k")).withColumn("score", F.lit(1.0))
    sure = scratch.written(sure, "sure")
    unseen = scratch.written(edges.where("k < 0").select("pattern", "inst").join(sure.select("inst"), "inst", "left_anti"), "unseen")
    learned, many = sure.limit(0), 0
    while True:
        known = sure.union(learned.select("inst", "k", "score"))
        scored = edges.select("pattern", "inst").join(known, "inst", "left")
        by_kind = scored.groupBy("pattern").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("k") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}") for k in range(len(KINDS))])
        best = F.greatest(*[F.struct(F.col(f"s{k}").alias("s"), F.lit(-k).alias("neg")) for k in range(len(KINDS))])
        kept = by_kind.select("pattern", "n", best.alias("b")).where((F.col("b.s") >= min_support) & (F.col("b.s") >= confidence * F.col("n")))
        kept = kept.select("pattern", (F.col("b.s") / F.col("n")).alias("score"), F.col("b.neg").alias("neg"))
        found = unseen.join(kept, "pattern").select("inst", "score", "neg")
        found = found.union(learned.select("inst", "score", (-F.col("k")).alias("neg")))
        found = found.groupBy("inst").agg(F.max(F.struct("score", "neg")).alias("b"))
        learned = scratch.written(found.select("inst", (-F.col("b.neg")).alias("k"), F.col("b.score").alias("score")), "learned")
        now = learned.count()
        if now == many:
            return learned.select("inst", "k")
        many = now


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row of `docs`: arrays of (s, k, e), k an index of KINDS.

    `spans` holds `base` and what the bootstrapped contexts added; added spans never overlap base ones.
    Null and empty texts have none. Repeated rows stay, and are further evidence for nothing:
    the graph counts distinct instances. Other columns are ignored. Texts are read once and don't move.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", t.alias("t")).withColumn("base", base(F.col("t")))
    may = F.when(F.col("t").rlike("[0-9@]"), candidates(F.col("t"), F.col("base"))).otherwise(F.array().cast(S.NONE))
    rows = rows.withColumn("occ", in_context(F.col("t"), F.concat("base", may)))
    place = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.transform("base", place).alias("base"), "occ")
    rows = scratch.written(rows, "occurrences")
    occ = rows.select("row", F.explode("occ").alias("o")).select("row", "o.*")
    learned = bootstrap(occ.select(F.explode("patterns").alias("pattern"), "inst", "k"))
    more = occ.where("k < 0").select("row", "s", "e", "inst").join(learned, "inst")
    more = more.groupBy("row").agg(F.collect_set(F.struct("s", "k", "e")).alias("more"))
    out = rows.select("row", "doc_id", "base").join(more, "row", "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>")))).alias("spans"))
