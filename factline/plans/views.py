"""Derived inputs: the star schema read as teams, contracts, holds, picks and trades.

Each view is a lazy DataFrame over whole tables. Money is `round(price * 100)` as bigint.
`views_sql.VIEWS` states the same definitions for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.functions import rules as R
from factline.functions import names as N
from factline.functions import text as X
from factline.operators import documents, position, trades
from factline.sources import scratch
from factline.sources.tables import Tables

# The agreement the derived seasons are judged under.
RULES = R.RuleSet(transition_season="1998-1999", base_season="1997-1998")
FIRST_SEASON, LAST_SEASON = 1994, 2002
BASE_CAP = 440_000_000
# Passages of the derived outlines are short; so is their ceiling.
CHUNK_CHARS = 600


def cents(c: Column) -> Column:
    """Whole cents; the figures carry two decimals, so no tie is ever rounded."""
    return F.floor(c * 100 + 0.5).cast("bigint")


def kicker_state() -> Column:
    return (
        F.when(F.col("tax") == 0, "absent").when(F.col("disc") == 0, "unknown").otherwise("known")
    )


def contract_id() -> Column:
    return F.concat_ws("-", "order_id", "line_no", "player", "team", "cap_figure").alias("contract_id")


class Views(Tables):
    """Views are planned where they are named. One that several branches of a plan read is
    written once with `keep`; views built on it then read the written table."""

    def __init__(self, spark, path: str):
        super().__init__(spark, path)
        self._kept: dict[str, DataFrame] = {}

    def keep(self, *names: str) -> None:
        for name in names:
            # Of units only what they are derived from is written: their titles and bodies repeat the line.
            name = "numbered_lines" if name == "units" else name
            if name not in self._kept:
                self._kept[name] = scratch.written(getattr(self, name), name)

    def of(self, name: str) -> DataFrame:
        """The written table of a view where there is one, else the view."""
        return self._kept[name] if name in self._kept else getattr(self, name)

    def over(self, docs: DataFrame) -> Views:
        """The views of these documents (doc_id, text) instead of all, as they lie."""
        out = Views(self.spark, self.path)
        out._kept["docs"] = docs
        return out

    # -- dimensions --------------------------------------------------------

    @property
    def teams(self) -> DataFrame:
        return (
            self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("team"),
                F.col("s_name").alias("name"),
                F.col("n_name").alias("division"),
                F.col("r_name").alias("conference"),
                cents(F.col("s_acctbal")).alias("balance"),
            )
        )

    @property
    def players(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("player"),
            F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("player_key"),
            F.col("p_name").alias("display_name"),
            R.floor_div(F.col("p_size").cast("bigint"), F.lit(4)).alias("years_of_service"),
            F.expr(
                "date_add(DATE'1955-01-01', cast(round((p_retailprice - 900) * 200) as int))"
            ).alias("birth_date"),
            F.col("p_type").alias("kind"),
            F.col("p_brand").alias("brand"),
            F.col("p_size").cast("bigint").alias("size"),
        )

    @property
    def seasons(self) -> DataFrame:
        """Eight rows, by rule: small enough to broadcast whatever the data is."""
        y = F.col("id")
        cap = F.lit(BASE_CAP).cast("bigint") + (y - 1997) * 4_000_000
        return self.spark.range(FIRST_SEASON, LAST_SEASON).select(
            y.alias("season"),
            R.season_id_of(y).alias("season_id"),
            cap.alias("salary_cap"),
            (cap + 30_000_000).alias("tax_level"),
            (cap + 60_000_000).alias("first_apron"),
            F.when(y == 1996, 0).otherwise(cap + 90_000_000).cast("bigint").alias("raw_second"),
            (cap + 90_000_000).alias("second_apron"),
            R.floor_div(cap * 9, F.lit(100)).alias("non_taxpayer_mle"),
            R.floor_div(cap * 4, F.lit(100)).alias("taxpayer_mle"),
        )

    # -- contracts ---------------------------------------------------------

    @property
    def _line_figures(self) -> DataFrame:
        """What a contract's columns are derived from; its id repeats these figures as text, so it never moves."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_suppkey").alias("team"),
            F.col("l_partkey").alias("player"),
            F.col("l_linenumber").cast("bigint").alias("line_no"),
            cents(F.col("l_extendedprice")).alias("cap_figure"),
            cents(F.col("l_discount")).alias("disc"),
            cents(F.col("l_tax")).alias("tax"),
            F.col("l_discount").alias("pct"),
            F.col("l_quantity").cast("bigint").alias("qty"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.col("l_shipdate").cast("date").alias("signed_date"),
        )

    @property
    def lines(self) -> DataFrame:
        return self._line_figures.select(contract_id(), "*")

    @property
    def contract_seasons(self) -> DataFrame:
        return self.contracts()

    def contracts(self, *by: str) -> DataFrame:
        """Contracts with the season of their order; dealt out `by` columns, as figures, where aggregates over these follow."""
        o = self.orders.select(
            F.col("o_orderkey").alias("order_id"),
            R.season_start(F.col("o_orderdate").cast("date")).alias("season"),
            F.col("o_orderdate").cast("date").alias("as_of"),
            F.col("o_orderpriority").alias("source"),
        )
        figures = self._line_figures
        rows = figures.join(o, "order_id")
        if by:
            rows = rows.repartition(*by)
        return (
            rows.select("order_id", contract_id(), *figures.columns[1:], "season", "as_of", "source")
            .withColumn("season_id", R.season_id_of(F.col("season")))
            .withColumn(
                "option_kind", F.when(F.col("flag") == "A", "player").when(F.col("flag") == "R", "team")
            )
            .withColumn("kicker_state", kicker_state())
            .withColumn(
                "ntc_state",
                F.when(F.col("flag") == "A", "unknown")
                .when((F.col("flag") == "R") & (F.col("status") == "O"), "known")
                .otherwise("absent"),
            )
            .withColumn(
                "guarantee_kind",
                F.when(F.col("tax") == 0, "full")
                .when(F.col("flag") == "A", "partial")
                .when(F.col("flag") == "R", "none")
                .otherwise("unknown"),
            )
            .withColumn(
                "contract_type",
                F.when(F.col("line_no") == 1, "rookie_first_round")
                .when(F.col("line_no") == 2, "rookie_second_round")
                .when(F.col("line_no") == 3, "sign_and_trade")
                .otherwise("unknown"),
            )
        )

    @property
    def years(self) -> DataFrame:
        return self.years_of(self.of("contract_seasons"))

    def years_of(self, contracts: DataFrame) -> DataFrame:
        """Contracts over several seasons: up to five, five percent more each year."""
        last = F.least(F.col("line_no"), F.lit(5)).cast("int") - 1
        return (
            contracts.select(
                "contract_id", "team", "player", "option_kind", "signed_date", "flag", "disc",
                F.col("season").alias("first_season"), "cap_figure",
                F.explode(F.sequence(F.lit(0), last)).alias("k"),
            )
            .withColumn("season", F.col("first_season") + F.col("k"))
            .withColumn(
                "cap_figure",
                F.col("cap_figure") + R.floor_div(F.col("cap_figure") * 5 * F.col("k"), F.lit(100)),
            )
            .withColumn(
                "guarantee_kind",
                F.when(F.col("k") == 0, "full")
                .when(F.col("flag") == "A", "partial")
                .when(F.col("flag") == "R", "none")
                .otherwise("unknown"),
            )
        )

    @property
    def ledger(self) -> DataFrame:
        return self.ledger_of(self.of("contract_seasons"))

    def ledger_of(self, contracts: DataFrame) -> DataFrame:
        """Contracts, dead money and holds as one long table, in a single pass."""
        none = F.lit(None)

        def row(kind: str, amount: Column, season: Column, label: Column, offer: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"),
                amount.alias("amount"),
                season.cast("bigint").alias("season"),
                label.cast("string").alias("label"),
                offer.cast("bigint").alias("offer"),
            )

        held = (F.col("status") == "O") & (F.col("disc") >= 8)
        amount = R.floor_div(F.col("cap_figure"), F.lit(4))
        label = (
            F.when(F.col("line_no") == 1, "Bird")
            .when(F.col("line_no") == 2, "Early Bird")
            .when(F.col("line_no") == 3, "Non-Bird")
            .when(F.col("line_no") == 4, "Restricted Bird")
            .when(F.col("line_no") == 5, "1st Round Pick")
            .otherwise("Two-Way")
        )
        rows = F.array(
            row("contract", F.col("cap_figure"), F.col("season"), none, none),
            F.when(
                F.col("tax") >= 8,
                row("dead", R.floor_div(F.col("cap_figure"), F.lit(10)), F.col("season"), none, none),
            ),
            F.when(
                held,
                row(
                    "hold",
                    amount,
                    F.when(F.col("flag") != "R", F.col("season")),
                    label,
                    F.when(F.col("tax") == 0, 0).otherwise(R.floor_div(amount, F.lit(2))),
                ),
            ),
        )
        return (
            contracts.select(
                "contract_id", "team", "player", "option_kind", "source", "as_of",
                F.explode(rows).alias("r"),
            )
            .where("r is not null")
            .select("contract_id", "team", "player", "option_kind", "source", "as_of", "r.*")
        )

    @property
    def holds(self) -> DataFrame:
        return self.of("ledger").where("kind = 'hold'").drop("option_kind")

    @property
    def dead(self) -> DataFrame:
        return self.of("ledger").where("kind = 'dead'").select(
            "contract_id", "team", "player", "season", "amount"
        )

    @property
    def ceilings(self) -> DataFrame:
        """Hard-cap ceilings by team and season; a team may hold both. Each misses one season in three."""
        t = self.teams
        rows = F.array(
            F.when(F.col("balance") < 300_000, F.lit("first_apron")),
            F.when(F.col("balance").between(100_000, 600_000), F.lit("second_apron")),
        )
        return t.select(
            "team",
            F.explode(rows).alias("level"),
            F.col("division").alias("category"),
            F.when(F.col("balance") >= 0, F.col("name")).alias("detail"),
        ).where("level is not null").join(
            F.broadcast(self.seasons.select("season", "season_id")),
            (F.col("team") + F.col("season") + F.length("level")) % 3 != 0,
        )

    @property
    def exceptions(self) -> DataFrame:
        """Lines sent back: what is left of each, and when it lapses."""
        return self.lines.where("flag = 'R'").select(
            "contract_id", "team",
            F.col("cap_figure").alias("amount"),
            R.floor_div(F.col("cap_figure") * F.col("disc"), F.lit(10)).alias("used"),
            F.col("signed_date").alias("created"),
            F.when(F.col("tax") > 0, F.add_months(F.col("signed_date"), 12)).alias("expires"),
            F.when(F.col("line_no") <= 4, "trade").when(F.col("line_no") == 5, "disabled_player").alias("kind"),
        )

    @property
    def picks(self) -> DataFrame:
        """Picks of two rounds 2027-2033 by original team, some conveyed or forfeited."""
        key = F.col("team")
        return (
            self.teams.select("team", F.explode(F.sequence(F.lit(2027), F.lit(2033))).alias("year"))
            .withColumn("year", F.col("year").cast("bigint"))
            .withColumn("round", F.explode(F.array(R.big(1), R.big(2))))
            .withColumn(
                "owner", F.when((key * 7 + F.col("year") + F.col("round") - 1) % 5 == 0, key + 1).otherwise(key)
            )
            .withColumn("forfeited", (key + F.col("year") + F.col("round") - 1) % 11 == 0)
            .withColumn("protected_to", key % 10)
            .withColumnRenamed("team", "original_team")
        )

    @property
    def first_picks(self) -> DataFrame:
        return self.picks.where("round = 1")

    @property
    def restrictions(self) -> DataFrame:
        return self.players.where("size >= 40").select(
            "player",
            F.when(F.col("kind") == "ECONOMY", "re_signed_with_raise")
            .otherwise("recently_signed")
            .alias("reason"),
            F.when(
                F.col("size") < 50,
                F.expr("date_add(DATE'1996-01-01', cast(size - 40 as int) * 220)"),
            ).alias("expires"),
            (F.col("kind") != "ECONOMY").alias("blocks_trade"),
        )

    @property
    def awards(self) -> DataFrame:
        """The three largest figures of each season."""
        w = W.partitionBy("season").orderBy(F.desc("cap_figure"), "contract_id")
        r = F.col("r")
        return (
            self.of("contract_seasons").select("season", "player", "cap_figure", "contract_id")
            .withColumn("r", F.row_number().over(w))
            .where(r <= 3)
            .select(
                "season", "player", F.lit("All-NBA").alias("award"),
                F.when(r == 1, "1st").when(r == 2, "2nd").otherwise("3rd").alias("tier"),
            )
        )

    @property
    def named_players(self) -> DataFrame:
        """Players with the name repeated forms share; the key is the name itself."""
        return self.part.groupBy(F.col("p_name").alias("player_key")).agg(
            F.min("p_partkey").alias("player")
        ).withColumn("display_name", F.initcap("player_key"))

    @property
    def requests(self) -> DataFrame:
        """Names as people ask for them: whole, cut short, surname only, or unknown."""
        name, size = F.col("p_name"), F.col("p_size")
        last = F.element_at(F.split(name, " "), -1)
        return self.part.select(
            F.when(size <= 12, name)
            .when(size <= 24, F.expr("substring(p_name, 3, length(p_name) - 3)"))
            .when(size <= 36, F.concat(F.lit("old "), last))
            .otherwise(F.concat(F.lit("qqq "), F.lower("p_type")))
            .alias("request")
        ).distinct()

    # -- positions and trades ----------------------------------------------

    @property
    def positions(self) -> DataFrame:
        # Totals are wider than what they are summed from, and rows joined by order hold every team: the figures move instead.
        return position.team_state(self.ledger_of(self.contracts("team")), self.seasons, self.ceilings)

    @property
    def move_shapes(self) -> DataFrame:
        """Orders as trades: every line leaves its team for the order's other end."""
        team = F.col("team")
        # Ends are found beside the figures, which move once; ids are made of them afterwards.
        trade = W.partitionBy("order_id")
        ended = self._line_figures.where("order_id is not null").withColumns(
            {"lo": F.min("team").over(trade), "hi": F.max("team").over(trade)}
        )
        return ended.select(
            F.col("order_id").alias("trade_id"),
            contract_id(), "player",
            team.alias("from_team"),
            F.when(team == F.col("hi"), F.col("lo")).otherwise(F.col("hi")).alias("to_team"),
            F.col("cap_figure").alias("amount"),
            kicker_state().alias("kicker_state"),
            "pct", "signed_date",
        )

    def _dated(self, shapes: DataFrame) -> DataFrame:
        d = F.col("o_orderdate").cast("date")
        season = R.season_start(d)
        o = self.orders.select(
            F.col("o_orderkey").alias("trade_id"),
            season.alias("season"),
            R.season_id_of(season).alias("season_id"),
            F.date_add(d, 120).alias("trade_date"),
        )
        return shapes.join(o, "trade_id")

    @property
    def moves(self) -> DataFrame:
        return self._dated(self.of("move_shapes"))

    @property
    def valid_moves(self) -> DataFrame:
        """Moves of well-formed trades; everything here is keyed by the trade, so the
        shape check, the orders and the moves share one partitioning."""
        m = self.of("move_shapes")
        return self._dated(trades.with_trade_errors(m).where("error is null").drop("error"))

    @property
    def legs(self) -> DataFrame:
        """One row per (trade, team) of well-formed trades, with the team's position."""
        known = position.with_known_teams(self.ledger_of(self.contracts("team")), self.teams, FIRST_SEASON, LAST_SEASON - 1)
        states = position.team_state(known, self.seasons, self.ceilings)
        return trades.leg_states(trades.leg_totals(self.of("valid_moves")), states, BASE_CAP)

    @property
    def asked(self) -> DataFrame:
        """(team, season, player) questions: the holding team, and the one after it."""
        return self.of("contract_seasons").select(
            F.explode(F.array(F.col("team"), F.col("team") + 1)).alias("team"), "season", "player"
        ).distinct().select("season", "player", "team")

    @property
    def held(self) -> DataFrame:
        """The first contract of each (team, season, player)."""
        c = F.struct(
            "contract_id", "cap_figure", "kicker_state", "ntc_state", "signed_date", "contract_type"
        )
        return (
            self.contracts("team", "season", "player")
            .groupBy("team", "season", "player")
            .agg(F.min(c).alias("c"))
            .select("team", "season", "player", "c.*")
        )

    @property
    def spans(self) -> DataFrame:
        """Events as trace spans: 64 consecutive events are one trace, each span has up to
        four children. The tree is arithmetic, so no trace needs its rows gathered."""
        event = F.col("event_id")
        trace, local = F.floor(event / 64).cast("bigint"), event % 64
        kinds = {"signup": "agent", "view": "retriever", "click": "event", "purchase": "generation"}
        kind = F.lit("tool")
        for name, as_kind in kinds.items():
            kind = F.when(F.col("event_type") == name, as_kind).otherwise(kind)
        return self.events.select(
            trace.alias("trace_id"),
            event.alias("span_id"),
            F.when(local > 0, trace * 64 + F.floor((local - 1) / 4)).cast("bigint").alias("parent_id"),
            kind.alias("kind"),
            F.col("event_type").alias("name"),
            F.col("ts").alias("started_at"),
            "value",
        )

    # -- documents ---------------------------------------------------------

    @property
    def docs(self) -> DataFrame:
        """Documents in plain letters: white space collapsed per line, empty lines gone."""
        lines = F.filter(
            F.transform(F.split(N.fold_ascii(F.col("text")), "\n"), X.squash), lambda x: x != ""
        )
        return self.documents.select("doc_id", F.array_join(lines, "\n").alias("text"), "lang", "source")

    @property
    def doc_lines(self) -> DataFrame:
        # Of a plain posexplode Spark infers a filter on the lines, for which texts are split once more before they move.
        lines = F.posexplode_outer(F.split("text", "\n")).alias("idx", "line")
        return self.of("docs").select("doc_id", lines, (F.length("text") + 1).cast("bigint").alias("doc_end")).where(
            "idx is not null"
        ).withColumn("idx", F.col("idx").cast("bigint"))

    @property
    def numbered_lines(self) -> DataFrame:
        """Lines with their level in the outline and the counts of sections and markers before them."""
        doc = W.partitionBy("doc_id").orderBy("idx")
        size = F.length("line")
        level = F.when(F.col("idx") == 0, 1).otherwise(2 + size % 3)

        def count(n: int, *inside: str) -> Column:
            w = W.partitionBy("doc_id", *inside).orderBy("idx")
            return F.sum(F.when(F.col("level") == n, 1).otherwise(0)).over(w)

        return (
            documents.page_starts(self.of("doc_lines"))
            .withColumn("level", level.cast("bigint"))
            .withColumn("sec", count(2))
            .withColumn("m3", count(3, "sec"))
            .withColumn("m4", count(4, "sec", "m3"))
        )

    @property
    def units(self) -> DataFrame:
        """Lines as an outline: the first is the article, the rest sections and markers."""
        size = F.length("line")
        words = F.split(F.trim(F.regexp_replace("line", "[^A-Za-z]+", " ")), " ")
        first2 = F.initcap(F.array_join(F.slice(words, 1, 2), " "))
        first1 = F.initcap(F.array_join(F.slice(words, 1, 1), " "))
        m3 = F.col("m3")
        letter = F.expr("repeat(char(97 + (m3 - 1) % 26), cast((m3 - 1) div 26 + 1 as int))")
        inner = F.concat(F.lit("("), letter, F.lit(")"))
        number = F.concat(F.lit("("), ((F.col("m4") - 1) % 5 + 1).cast("string"), F.lit(")"))
        own = F.when(F.col("level") == 3, inner).when(F.col("level") == 4, number).otherwise("")
        df = self.of("numbered_lines").withColumn("first1", first1).withColumn("first2", first2)
        section = F.when((F.col("sec") > 0) & (F.col("level") > 1), F.col("sec").cast("string"))
        markers = F.when((F.col("level") == 4) & (m3 > 0), F.concat(inner, number)).otherwise(own)
        line = F.col("line")
        title = (
            F.when(F.col("level") == 1, F.concat(F.lit("Article VII "), line))
            .when(F.col("level") == 2, F.concat(F.lit("Section "), F.col("sec").cast("string"), F.lit(". "), F.col("first2"), F.lit(". "), line))
            .when(F.col("level") == 3, F.concat(inner, F.lit(" "), F.col("first2"), F.lit(": "), line))
            .otherwise(F.concat(number, F.lit(" "), line))
        )
        quoted = lambda c: F.concat(F.lit("“"), c, F.lit("”"))
        body = (
            F.when((F.col("level") == 3) & (size % 2 == 0), F.concat(own, F.lit(" "), quoted(F.col("first2")), F.lit(" means "), line))
            .when(F.col("level") == 3, F.concat(own, F.lit(" The term "), quoted(F.col("first2")), F.lit(" or "), quoted(F.col("first1")), F.lit(" shall mean "), line))
            .when((F.col("level") == 4) & (size % 4 == 0), F.concat(own, F.lit(" "), quoted(F.col("first2")), F.lit(" (see "), quoted(F.col("first1")), F.lit(") "), line))
            .otherwise(line)
        )
        refs = (
            F.when(F.col("level") == 1, " See Article X, Section 1 and Section 2.")
            .when(F.col("level") == 2, F.concat(F.lit(" Under Article VII, Section "), (size % 4 + 1).cast("string"), F.lit("(a)(2) and Section 401(a) of the Code.")))
            .when(F.col("level") == 3, F.concat(F.lit(" As in Section "), (size % 6 + 1).cast("string"), F.lit("(b)(1)(i).")))
            .otherwise(" Section 302(c)(5) of the Labor Management Relations Act of 1947, Section 1(a).")
        )
        return df.select(
            "doc_id", "idx", "level", "line", "start", "doc_end",
            F.lit("VII").alias("article"),
            section.alias("section"),
            F.when(section.isNotNull(), markers).otherwise(F.lit("")).alias("markers"),
            title.alias("title"), body.alias("body"), F.concat(line, refs).alias("ref_body"),
            (F.col("level") == 2).alias("is_section"),
            F.when(F.col("sec") > 0, 2).alias("section_level"),
        ).withColumn(
            "citation",
            documents.citation(F.col("article"), F.col("section"), F.col("markers"), F.col("title")),
        )

    @property
    def outlined(self) -> DataFrame:
        # Texts that nothing reads off the outline don't move with it; the line orders units that share a place.
        return documents.outline(self.of("units").drop("body", "ref_body")).drop("line")

    @property
    def chunks(self) -> DataFrame:
        return documents.with_ordinal(documents.chunk_spans(self.of("outlined"), CHUNK_CHARS))

    @property
    def definitions(self) -> DataFrame:
        return documents.extract_definitions(self.of("units"))

    @property
    def definition_names(self) -> DataFrame:
        return documents.definition_names(self.of("units"))

    @property
    def refs(self) -> DataFrame:
        return documents.resolve_refs(
            documents.extract_refs(self.of("units").withColumn("body", F.col("ref_body"))), self.of("units")
        )

    @property
    def edges(self) -> DataFrame:
        return self.of("refs").where("found").select("doc_id", "source", "target")

    # -- trades as text ----------------------------------------------------

    @property
    def leg_text(self) -> DataFrame:
        """Each leg of a well-formed trade as the text a tracker prints for it.

        A well-formed trade has at most sixteen moves, so what is gathered per leg is bounded.
        """
        m = self.of("valid_moves")
        money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
        receive = (F.col("direction") == "receive") & F.col("team").isNotNull()
        moves = m.withColumns(
            {"sender": F.col("from_team"), "n_teams": F.size(F.collect_set("from_team").over(W.partitionBy("trade_id")))}
        )
        # What a leg takes in is gathered beside its totals, over all dates of its trade.
        base = trades.leg_totals(
            moves, F.first("n_teams").alias("n_teams"),
            F.collect_list(F.when(receive, F.struct("sender", "contract_id", "amount"))).alias("taken"),
        ).withColumn("taken", F.array_sort(F.flatten(F.collect_list("taken").over(W.partitionBy("trade_id", "team")))))

        def printed(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(F.col("taken"), i - 1)["sender"])
            salary = F.coalesce(F.concat(F.lit("· "), money(x["amount"]), F.lit(" ")), F.lit(""))
            name = F.concat(F.lit("From T"), x["sender"].cast("string"), F.lit(": "))
            return F.when(F.col("n_teams") == 2, F.when(x["sender"].eqNullSafe(F.get(F.col("taken"), F.lit(0))["sender"]), salary)).otherwise(
                F.concat(F.when(before == x["sender"], "").otherwise(name), salary)
            )

        off = F.when((F.col("season") == 1996) & (F.col("n_receives") >= 4), 1000).otherwise(0)
        total = F.col("incoming_base") + off
        change = total - F.col("outgoing")
        head = F.array_join(F.transform("taken", printed), "")
        return base.select(
            "trade_id", "team", F.col("trade_date").alias("date"),
            F.concat(
                F.coalesce(head, F.lit("")),
                F.when(F.col("n_receives") >= 3, "2027 1st round pick ").otherwise(""),
                F.lit("Cap Hit Sum: "), money(total),
                F.lit(" Cap Hit Change: "), F.when(change >= 0, "+").otherwise("-"), money(F.abs(change)),
                F.when(F.col("n_sends") == 1, F.concat(F.lit(" Cash: "), money(F.col("outgoing") % 1000 + 100))).otherwise(""),
                F.when(change < 0, " Trade Exceptions Generated: 1").otherwise(""),
            ).alias("detail"),
        )
