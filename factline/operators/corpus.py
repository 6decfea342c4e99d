"""Trades read from text, judged as a corpus, mutated and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.functions import constants as K
from factline.functions import rules as R


def single_capacity(outgoing: Column, cap: Column, base_cap: Column) -> Column:
    """The most any single exception permits, the allowance kept."""
    cush = R.big(K.ALLOWANCE)
    return F.greatest(
        R.allow_standard(outgoing, cush), R.allow_expanded(outgoing, cush, cap, base_cap)
    )


def permits(outgoing: Column, incoming: Column, capacity: Column) -> Column:
    return (outgoing > 0) & (incoming <= capacity)


# -- fixed values: how a leg's text is read --------------------------------

CAP_HIT_SUM = r"Cap Hit Sum:\s*\$?(-?[\d,]+)"
CAP_HIT_CHANGE = r"Cap Hit Change:\s*([+-])\$?([\d,]+)"
CASH = r"Cash:\s*\$?([\d,]+)"
TPE_GENERATED = "Trade Exceptions Generated:"
PICK = r"(20\d\d)\s+(1st|2nd)\s+round pick"
PLAYER_SALARY = r"·\s*\$([\d,]+)"
TEAM_CODE = "[A-Z]{3}"

INFLATE_FACTOR = 4
INFLATE_PLUS = 10_000_000
UNBALANCE_BY = 7_777_777


def _money(c: Column) -> Column:
    return F.translate(c, ",", "").try_cast("bigint")


def _head(detail: Column) -> Column:
    return F.substring_index(detail, "Cap Hit Sum", 1)


def parse_legs(legs: DataFrame) -> DataFrame:
    """Facts of each leg's text; a leg without a sum or a change is left out.

    legs (trade_id, date, team, detail).
    """
    d = F.col("detail")
    total = _money(F.regexp_extract(d, CAP_HIT_SUM, 1))
    sign = F.when(F.regexp_extract(d, CAP_HIT_CHANGE, 1) == "+", 1).otherwise(-1)
    change = sign * _money(F.regexp_extract(d, CAP_HIT_CHANGE, 2))
    salaries = F.transform(F.regexp_extract_all(_head(d), F.lit(PLAYER_SALARY), F.lit(1)), _money)
    return legs.where(d.rlike(CAP_HIT_SUM) & d.rlike(CAP_HIT_CHANGE)).select(
        "trade_id",
        "date",
        "team",
        total.alias("incoming"),
        (total - change).alias("outgoing"),
        F.coalesce(_money(F.regexp_extract(d, CASH, 1)), R.big(0)).alias("cash_received"),
        F.size(F.regexp_extract_all(d, F.lit(PICK), F.lit(0))).cast("bigint").alias("picks"),
        F.contains(d, F.lit(TPE_GENERATED)).alias("generated_tpe"),
        salaries.alias("incoming_salaries"),
    )


def incoming_by_source(legs: DataFrame, code: str = TEAM_CODE) -> DataFrame:
    """Salaries each leg takes in, by the team named before them; a null source where none is."""
    stop = f"(?=From {code}:|Cap Hit Sum|Trade Exceptions|$)"
    block = f"(?s)From ({code}):(.*?){stop}"
    d = F.col("detail")
    named = F.arrays_zip(
        F.regexp_extract_all(d, F.lit(block), F.lit(1)).alias("source"),
        F.regexp_extract_all(d, F.lit(block), F.lit(2)).alias("body"),
    )
    whole = F.array(F.struct(F.lit(None).cast("string").alias("source"), _head(d).alias("body")))
    rows = legs.select(
        "trade_id", "team", F.explode(F.when(F.size(named) > 0, named).otherwise(whole)).alias("b")
    )
    return rows.select(
        "trade_id",
        "team",
        F.col("b.source").alias("source"),
        F.transform(
            F.regexp_extract_all(F.col("b.body"), F.lit(PLAYER_SALARY), F.lit(1)), _money
        ).alias("salaries"),
    )


def build_cases(parsed: DataFrame, min_season: str) -> DataFrame:
    """Legs with their case: fiscal year, number of legs, and whether the figures balance."""
    start = F.when(F.month("date") >= 7, F.year("date")).otherwise(F.year("date") - 1)
    dated = parsed.where("date is not null").withColumn(
        "season_id", R.season_id_of(start.cast("bigint"))
    ).where(F.col("season_id") >= min_season)
    # Sums stand beside the legs, which move once.
    trade = W.partitionBy("trade_id")
    return dated.where("trade_id is not null").withColumns(
        {
            "n_legs": F.count("*").over(trade),
            "total_in": F.sum("incoming").over(trade).cast("bigint"),
            "total_out": F.sum("outgoing").over(trade).cast("bigint"),
        }
    ).withColumn("balanced", F.col("total_in") == F.col("total_out"))


def reconstruct_outgoing(cases: DataFrame, blocks: DataFrame, code_of: Column) -> DataFrame:
    """One row per salary a team sent, read from what the others took in.

    `code_of` turns a team into the code the text names it by. An unattributed block counts
    only in a trade of two legs.
    """
    sides = cases.select("trade_id", "team", "n_legs").withColumn("code", code_of)
    taken = (
        blocks.withColumnRenamed("team", "taker")
        .select("trade_id", "taker", "source", F.posexplode("salaries").alias("pos", "amount"))
    )
    other = (F.col("taker") != F.col("team")) & F.when(
        F.col("source").isNull(), F.col("n_legs") == 2
    ).otherwise(F.col("source") == F.col("code"))
    return sides.join(taken, "trade_id").where(other).select(
        "trade_id", "team", "taker", "pos", "amount"
    )


def with_capacity(cases: DataFrame, sent: DataFrame, seasons: DataFrame, base_cap: int) -> DataFrame:
    """Legs with the most a simultaneous exception permits them to take back.

    Where the salaries sent add up to the outgoing figure the best split counts, else the best
    single exception. A season without figures leaves capacity null.
    """
    from factline.operators import structures

    keys = ["trade_id", "team"]
    sums = sent.groupBy(*keys).agg(
        F.sum("amount").cast("bigint").alias("sent_total"), F.count("*").alias("n_sent")
    )
    legs = (
        cases.join(F.broadcast(seasons.select("season_id", "salary_cap")), "season_id", "left")
        .join(sums, keys, "left")
        .withColumn("base_cap", R.big(base_cap))
        .withColumn("cushion", R.big(K.ALLOWANCE))
        .withColumn(
            "reconstructed", F.coalesce(F.col("sent_total") == F.col("outgoing"), F.lit(False))
        )
    )
    trusted = legs.where("reconstructed and salary_cap is not null").select(
        *keys, "cushion", "salary_cap", "base_cap"
    )
    split = structures.best_structures(sent, trusted, keys, ["amount", "taker", "pos"]).select(
        *keys, "structure_total"
    )
    single = single_capacity(F.col("outgoing"), F.col("salary_cap"), F.col("base_cap"))
    return legs.join(split, keys, "left").withColumn(
        "capacity",
        F.when(F.col("reconstructed"), F.coalesce("structure_total", R.big(0))).otherwise(single),
    )


def evaluate_cases(legs: DataFrame, rules: R.RuleSet = R.RuleSet()) -> DataFrame:
    """Every check of every case with its outcome; a null team for checks of the whole case."""
    known = F.col("salary_cap").isNotNull()
    whole = legs.groupBy("trade_id").agg(
        F.min("balanced").alias("balanced"), F.max(known).alias("known")
    ).select(
        "trade_id",
        F.lit(None).cast("bigint").alias("team"),
        F.when(F.col("known"), "corpus_balance").otherwise("season_constants").alias("check"),
        F.when(~F.col("known"), "skipped").when(F.col("balanced"), "pass").otherwise("fail").alias("outcome"),
    )
    cush = F.col("cushion")
    one = R.best_allowance(
        F.col("outgoing"), F.col("incoming"), cush, F.col("season_id"), F.col("salary_cap"),
        F.col("base_cap"), F.lit(True), F.lit(None).cast("bigint"), rules=rules,
    )
    by_split = F.col("reconstructed") & (F.col("incoming") <= F.col("capacity"))
    needs = F.col("incoming") > F.col("outgoing")
    permitted = ~needs | by_split | one.isNotNull()

    def check(name: str, outcome: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), outcome.alias("outcome"))

    skipped = F.lit("skipped")
    rows = F.array_compact(
        F.array(
            check("salary_matching", F.when(permitted, "pass").otherwise("skipped")),
            F.when(needs, check("hard_cap_ceiling", skipped)),
            F.when(needs, check("allowance_removal", skipped)),
        )
    )
    per_leg = legs.where(known & F.col("balanced")).select("trade_id", "team", F.inline(rows))
    return whole.unionByName(per_leg)


def tally(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check").agg(
        *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("pass", "fail", "skipped")]
    )


def failures(checks: DataFrame) -> DataFrame:
    return checks.where("outcome = 'fail'")


def mutants(legs: DataFrame) -> DataFrame:
    """Illegal variants of conclusively legal legs, and one unbalanced variant per case.

    Only what is still illegal afterwards is kept.
    """
    sound = legs.where("balanced and salary_cap is not null")
    out, inc, cap = F.col("outgoing"), F.col("incoming"), F.col("capacity")
    legal = (out > 0) & ((inc <= out) | permits(out, inc, cap))

    def variant(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("bigint").alias("mutated"))

    inflated = F.greatest(inc, out) * INFLATE_FACTOR + INFLATE_PLUS
    made = sound.where(legal).select(
        "trade_id", "team", "outgoing", "capacity",
        F.inline(F.array(variant("inflate_incoming", inflated), variant("just_over_the_band", cap + 1))),
    ).where(~permits(out, F.col("mutated"), cap))
    first = (
        sound.where(inc > 0)
        .groupBy("trade_id")
        .agg(F.min_by(F.struct("team", "outgoing", "capacity", "incoming"), "team").alias("l"))
        .select(
            "trade_id", "l.team", "l.outgoing", "l.capacity",
            F.lit("unbalance").alias("kind"), (F.col("l.incoming") + UNBALANCE_BY).alias("mutated"),
        )
    )
    return made.unionByName(first.select(*made.columns))


#: What a mutant should be caught for.
EXPECTED = {"inflate_incoming": "no_exception_available", "just_over_the_band": "no_exception_available", "unbalance": "unbalanced"}


def detect(found: DataFrame, legs: DataFrame) -> DataFrame:
    """Whether each mutant is caught, and for the stated reason: every check is made again on its figures.

    `code` is what is wrong with the trade as mutated, null if nothing is: its sums where those were
    changed, else the rule on the leg. legs are the real ones, one row a trade and team.
    """
    sums = legs.groupBy("trade_id").agg(F.sum("incoming").alias("total_in"), F.sum("outgoing").alias("total_out"))
    was = legs.select("trade_id", "team", F.col("incoming").alias("was"))
    both = found.join(was, ["trade_id", "team"]).join(sums, "trade_id")
    even = F.col("total_in") - F.col("was") + F.col("mutated") == F.col("total_out")
    allowed = permits(F.col("outgoing"), F.col("mutated"), F.col("capacity"))
    code = F.when(F.col("kind") == "unbalance", F.when(~even, "unbalanced")).when(~allowed, "no_exception_available")
    stated = F.element_at(F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv]), F.col("kind"))
    out = both.withColumn("code", code).drop("was", "total_in", "total_out")
    return out.withColumn("detected", F.col("code").isNotNull()).withColumn(
        "right_reason", F.coalesce(F.col("code") == stated, F.lit(False))
    )


def score(found: DataFrame, legs: DataFrame) -> DataFrame:
    """Recall, precision floor and reason accuracy; nothing to divide by is 0.0."""
    marks = detect(found, legs).agg(
        F.count("*").alias("n_mutants"),
        F.count_if("detected").alias("detected"),
        F.count_if(F.col("detected") & F.col("right_reason")).alias("right_reason"),
    )
    out, inc = F.col("outgoing"), F.col("incoming")
    real = legs.where("balanced and salary_cap is not null").agg(
        F.count_if((inc > out) & (out > 0) & ~permits(out, inc, F.col("capacity"))).alias("undeterminable")
    )
    one = marks.withColumn("k", F.lit(1)).join(real.withColumn("k", F.lit(1)), "k").drop("k")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))

    d = F.col("detected")
    return one.select(
        "*",
        ratio(d, F.col("n_mutants")).alias("recall"),
        ratio(d, d + F.col("undeterminable")).alias("precision_floor"),
        ratio(F.col("right_reason"), d).alias("reason_accuracy"),
    )
