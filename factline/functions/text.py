"""Facts out of page fragments, notes and free text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from factline.functions.folds import bind

# -- fixed values: patterns the sources are read by ------------------------

NOTE_SIGNED = r"Signed\s+(\d+)-yr/\$([\d.]+)([MK])\s+([^.]*?)(\w+\s+\d+,\s+\d{4})"
NOTE_OPTION = r"(?i)(\d{4}-\d{2})\s+is\s+a\s+(team|player)\s+option"
NOTE_TRADE = r"Traded from (\w+) to (\w+) (\w+\s+\d+,\s+\d{4})"
NOTE_EXERCISED = r"Option exercised (\w+\s+\d+,\s+\d{4})"
SEASON = r"(\d{4}-\d{2})"
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)"


# -- markup ----------------------------------------------------------------


def _code_point(body: Column) -> Column:
    """The number of a `#...` reference; more than a code point can have is 0x110000."""
    hexadecimal = body.rlike("^#[xX]")
    digits = F.regexp_replace(F.regexp_replace(body, "^#[xX]?0*", ""), ";", "")
    wide = F.length(digits) > F.when(hexadecimal, 6).otherwise(7)
    number = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    return F.when(digits == "", 0).when(wide, 0x110000).otherwise(number)


def _character(code: Column) -> Column:
    """A reference's character: replacements for what has none, nothing for control codes and noncharacters."""
    windows = {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
    table = F.create_map(*[F.lit(x) for c, ch in windows.items() for x in (c, ch)])
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    none = code.between(1, 8) | code.between(14, 31) | (code == 11) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    safe = F.when(bad | none, 32).otherwise(code)
    char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    return F.when(bad, "\ufffd").when(code == 13, "\r").when(code.between(0x80, 0x9F), F.element_at(table, code.cast("int"))).when(none, "").otherwise(char)


def _decode_entity(e: Column) -> Column:
    """One `&...` as its character; a name is looked up whole, then by the longest old name it begins with."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    body = F.substr(e, F.lit(2))
    old = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    begins = F.regexp_extract(body, "^(" + "|".join(old) + ")", 1)
    partly = F.when(begins != "", F.concat(F.try_element_at(names, begins), F.substr(body, F.length(begins) + 1)))
    return F.when(body.startswith("#"), _character(_code_point(body))).otherwise(F.coalesce(F.try_element_at(names, body), partly, e))


def unescape(c: Column) -> Column:
    """Entities decoded once, left to right, so a decoded `&` starts no second entity."""
    pieces = F.split(c, ENTITY)
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({ENTITY})"), F.lit(1)), _decode_entity)
    joined = F.zip_with(
        pieces, found, lambda p, e: F.concat(F.coalesce(p, F.lit("")), F.coalesce(e, F.lit("")))
    )
    return F.when(F.contains(c, F.lit("&")), F.array_join(joined, "")).otherwise(c)


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_tags(c: Column) -> Column:
    return squash(unescape(F.regexp_replace(c, "<[^>]+>", " ")))


_INSIDE_TAG = r"""(?:"[^"]*+"|'[^']*+'|[^'">])*+>"""


def marks(c: Column, tags: tuple[str, ...]) -> Column:
    """A page as its tags of these names, in any case, and the text between them, in order.

    Quoted values may hold `>`. Comments and all other tags become a space; entities stay as they are.
    """
    names = "|".join(tags)
    other = rf"(?is)<!--.*?-->|<(?!/?(?:{names})[\s/>]){_INSIDE_TAG}"
    ours = rf"(?is)</?(?:{names})(?=[\s/>]){_INSIDE_TAG}|[^<]++|<"
    return F.regexp_extract_all(F.regexp_replace(c, other, " "), F.lit(ours), F.lit(0))


def tables(c: Column, table: str, header: str, row: str, cell: str | None) -> Column:
    """The tables of a page: an array of (table_no, headers, rows), rows being (row_no, cells), in order of opening.

    Tags are read one by one with a stack of the tables that are open, so a table inside a cell is one of its
    own and its text not the cell's. Tags left open are closed by what follows. Without `cell`, a
    row is its only cell. Rows without cells are counted and left out, headers without text too.
    """
    cells = "array<string>"
    rows = "array<struct<row_no:int,cells:array<string>>>"
    kind = f"struct<no:int,row:int,part:string,text:string,headers:{cells},cells:{cells},rows:{rows}>"
    fields = ("no", "row", "part", "text", "headers", "cells", "rows")
    blank = F.struct(
        F.lit(-1).alias("row"), F.lit("").alias("part"), F.lit("").alias("text"), F.array().cast(cells).alias("headers"),
        F.array().cast(cells).alias("cells"), F.array().cast(rows).alias("rows"),
    )

    def entry(t: Column, **new: Column) -> Column:
        return F.struct(*[(new[f] if f in new else t[f]).alias(f) for f in fields]).cast(kind)

    def end_part(t: Column) -> Column:
        """The cell or header that is open, if one is, closed."""
        return (
            F.when(t["part"] == "header", entry(t, part=F.lit(""), text=F.lit(""), headers=F.concat(t["headers"], F.array(t["text"]))))
            .when(t["part"] == "cell", entry(t, part=F.lit(""), text=F.lit(""), cells=F.concat(t["cells"], F.array(t["text"]))))
            .otherwise(t)
        )

    def end_row(t: Column) -> Column:
        full = F.concat(t["rows"], F.array(F.struct(t["row"].alias("row_no"), t["cells"].alias("cells"))))
        return F.when(F.size(t["cells"]) > 0, entry(t, cells=F.array().cast(cells), rows=full)).otherwise(t)

    def step(acc: Column, token: Column) -> Column:
        stack = acc["stack"]
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
        closing = token.startswith("</")

        def by_tag(own: Column) -> Column:
            """`own`: the stack without its top, and the top with its open part closed."""

            def with_top(t: Column) -> Column:
                return F.struct(acc["n"].alias("n"), F.concat(own["under"], F.array(t)).alias("stack"), acc["done"].alias("done"))

            shut = end_row(own["top"])
            begins = F.lit("cell" if cell is None else "")
            does = (
                F.when(name == table, F.struct(acc["n"].alias("n"), own["under"].alias("stack"), F.concat(acc["done"], F.array(shut)).alias("done")))
                .when((name == row) & ~closing, with_top(bind(shut, lambda t: entry(t, row=t["row"] + 1, part=begins))))
                .when(name == row, with_top(shut))
                .when((name == header) & ~closing, with_top(entry(own["top"], part=F.lit("header"))))
            )
            if cell is not None:
                does = does.when((name == cell) & ~closing, with_top(entry(own["top"], part=F.lit("cell"))))
            return does.otherwise(with_top(own["top"]))

        opened = F.struct(acc["n"].alias("no"), *[blank[f].alias(f) for f in fields[1:]]).cast(kind)
        top, under = F.element_at(stack, -1), F.slice(stack, F.lit(1), F.size(stack) - 1)
        more = F.transform(F.slice(stack, F.size(stack), F.lit(1)), lambda t: entry(t, text=F.when(t["part"] == "", F.lit("")).otherwise(F.concat(t["text"], token))))
        return (
            F.when((name == table) & ~closing, F.struct((acc["n"] + 1).alias("n"), F.concat(stack, F.array(opened)).alias("stack"), acc["done"].alias("done")))
            .when(F.size(stack) == 0, acc)
            .when(name == "", F.struct(acc["n"].alias("n"), F.concat(under, more).alias("stack"), acc["done"].alias("done")))
            .otherwise(bind(F.struct(under.alias("under"), end_part(top).alias("top")), by_tag))
        )

    start = F.struct(F.lit(0).alias("n"), F.array().cast(f"array<{kind}>").alias("stack"), F.array().cast(f"array<{kind}>").alias("done"))
    tags = tuple(dict.fromkeys((table, header, row, *([cell] if cell else []))))
    last = lambda acc: F.concat(acc["done"], F.transform(acc["stack"], lambda t: bind(end_part(t), end_row)))
    found = F.aggregate(marks(c, tags), start, step, last)

    def told(t: Column) -> Column:
        heads = F.filter(F.transform(t["headers"], strip_tags), lambda h: h != "")
        clean = lambda r: F.struct(r["row_no"].alias("row_no"), F.transform(r["cells"], strip_tags).alias("cells"))
        return F.struct(t["no"].alias("table_no"), heads.alias("headers"), F.transform(t["rows"], clean).alias("rows"))

    return F.transform(F.array_sort(found), told)


def repair_name(cell: Column) -> Column:
    """The anchor's text, else the text without a leading word repeated at the end."""
    anchor = strip_tags(F.regexp_extract(cell, r"(?s)<a[^>]*>(.*?)</a>", 1))
    raw = strip_tags(cell)
    words = F.split(raw, " ")
    doubled = (F.size(words) >= 3) & (F.get(words, F.lit(0)) == F.element_at(words, -1))
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.when(anchor != "", anchor).when(doubled, rest).otherwise(raw)


# -- values ----------------------------------------------------------------


def parse_money(text: Column, sort_key: Column | None = None) -> Column:
    """Digits as a whole number, negative behind a leading minus; a numeric sort key wins."""
    digits = F.regexp_replace(text, r"[^\d]", "").try_cast("bigint")
    value = F.when(F.ltrim(text).startswith("-"), -digits).otherwise(digits)
    if sort_key is None:
        return value
    return F.coalesce(F.when(sort_key.rlike(r"^-?\d+$"), sort_key.try_cast("bigint")), value)


def as_int(c: Column) -> Column:
    """A number's whole part; anything else is null."""
    return c.cast("string").try_cast("double").try_cast("bigint")


def parse_date_any(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MMMM d, yyyy", "M/d/yyyy")) -> Column:
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in formats])


def parse_service_years(c: Column) -> Column:
    return F.when(F.upper(c) == "R", 0).when(c.rlike(r"^\d+$"), c.try_cast("bigint")).cast("bigint")


def scaled(number: Column, unit: Column) -> Column:
    """`12.5`, `M` as 12500000."""
    factor = F.when(unit == "M", 1_000_000).when(unit == "K", 1_000)
    return (number.try_cast("double") * factor).try_cast("bigint")


# -- notes -----------------------------------------------------------------


def note_facts(note: Column) -> list[Column]:
    """Signing, options, exercise and trade facts of a free-text note."""

    def part(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(note, pattern, i), F.lit(""))

    signed = note.rlike(NOTE_SIGNED)
    pairs = F.arrays_zip(
        F.regexp_extract_all(note, F.lit(NOTE_OPTION), F.lit(1)).alias("s"),
        F.regexp_extract_all(note, F.lit(NOTE_OPTION), F.lit(2)).alias("k"),
    )
    options = F.array_join(
        F.transform(pairs, lambda p: F.concat(p["s"], F.lit(":"), F.lower(p["k"]))), "|"
    )
    return [
        part(NOTE_SIGNED, 5).alias("signed_date"),
        part(NOTE_SIGNED, 1).try_cast("bigint").alias("contract_years"),
        scaled(part(NOTE_SIGNED, 2), part(NOTE_SIGNED, 3)).alias("contract_value"),
        F.when(
            signed, F.contains(F.lower(F.regexp_extract(note, NOTE_SIGNED, 4)), F.lit("extension"))
        ).alias("is_extension"),
        F.nullif(options, F.lit("")).alias("option_seasons"),
        part(NOTE_EXERCISED, 1).alias("option_exercised"),
        part(NOTE_TRADE, 1).alias("traded_from"),
        part(NOTE_TRADE, 3).alias("traded_date"),
    ]


def classify_decision(c: Column) -> list[Column]:
    """Kind and holder of a dated decision, by what its text mentions first in this order."""
    low = F.lower(c)

    def says(what: str) -> Column:
        return F.contains(low, F.lit(what))

    kind = (
        F.when(says("option"), "option")
        .when(says("qualifying offer"), "qualifying_offer")
        .when(says("guaranteed"), "guarantee")
        .when(says("extension eligible"), "extension_eligible")
        .otherwise("other")
    )
    holder = F.when(says("player option"), "player").when(says("club option"), "club")
    note = F.when(
        F.contains(c, F.lit("—")), F.trim(F.regexp_extract(c, "(?s)—(.*)$", 1))
    ).when(F.contains(c, F.lit(" - ")), F.trim(F.regexp_extract(c, "(?s)^.*? - (.*)$", 1)))
    return [
        kind.alias("kind"),
        holder.alias("holder"),
        F.nullif(F.regexp_extract(c, SEASON, 1), F.lit("")).alias("season"),
        note.alias("note"),
    ]


# -- figures ---------------------------------------------------------------

# Fixed pattern: dollar amounts, percentages, comma-grouped numbers.
FIGURE = r"\$\s?[\d,]+(?:\.\d+)?|\b\d+(?:\.\d+)?\s?%|\b\d{1,3}(?:,\d{3})+\b"


def figures_in(c: Column) -> Column:
    """Figures of a text, distinct, in the order they appear."""
    found = F.regexp_extract_all(c, F.lit(f"({FIGURE})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda f: F.trim(f)))
