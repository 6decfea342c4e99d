"""Keys from names: one spelling per person, one code per team."""

from __future__ import annotations

import json
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- fixed values ----------------------------------------------------------

SUFFIXES = r"\b(jr|sr|ii|iii|iv|v)\b\.?"

ALIASES = {
    "nicolas claxton": "nic claxton",
    "herb jones": "herbert jones",
    "nahshon hyland": "bones hyland",
    "cameron christie": "cam christie",
    "jeenathan williams": "nate williams",
    "cameron thomas": "cam thomas",
    "cameron johnson": "cam johnson",
    "cameron payne": "cam payne",
    "kentavious caldwell pope": "kentavious caldwellpope",
    "hansen yang": "yang hansen",
    "sviatoslav mykhailiuk": "svi mykhailiuk",
}

CANONICAL_CODES = {
    "BKN": "BRK",
    "CHA": "CHO",
    "PHX": "PHO",
    "NO": "NOP",
    "NY": "NYK",
    "GS": "GSW",
    "SA": "SAS",
    "UTAH": "UTA",
}

NICKNAMES = {
    "hawks": "ATL",
    "celtics": "BOS",
    "nets": "BRK",
    "hornets": "CHO",
    "bulls": "CHI",
    "cavaliers": "CLE",
    "mavericks": "DAL",
    "nuggets": "DEN",
    "pistons": "DET",
    "warriors": "GSW",
    "rockets": "HOU",
    "pacers": "IND",
    "clippers": "LAC",
    "lakers": "LAL",
    "grizzlies": "MEM",
    "heat": "MIA",
    "bucks": "MIL",
    "timberwolves": "MIN",
    "pelicans": "NOP",
    "knicks": "NYK",
    "thunder": "OKC",
    "magic": "ORL",
    "76ers": "PHI",
    "sixers": "PHI",
    "suns": "PHO",
    "blazers": "POR",
    "trailblazers": "POR",
    "kings": "SAC",
    "spurs": "SAS",
    "raptors": "TOR",
    "jazz": "UTA",
    "wizards": "WAS",
}

# -- accents, by rule ------------------------------------------------------


def _ascii_of(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()


def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters folding to one ASCII character, and those folding to several."""
    one_from, one_to, many = [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        folded = _ascii_of(chr(cp))
        if len(folded) == 1:
            one_from.append(chr(cp))
            one_to.append(folded)
        elif len(folded) > 1:
            many[chr(cp)] = folded
    return "".join(one_from), "".join(one_to), many


_FROM, _TO, _MANY = _folds()


def fold_ascii(c: Column) -> Column:
    """Compatibility-decomposed text with everything outside ASCII dropped.

    Plain text passes through. Letters that fold to one are translated; only what is still outside ASCII
    then is looked up character by character.
    """
    single = F.translate(c, _FROM, _TO)
    table = F.from_json(F.lit(json.dumps(_MANY)), "map<string,string>")
    several = F.array_join(F.transform(F.split(single, ""), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.try_element_at(table, x)).otherwise(x)), "")
    return F.when(~c.rlike(r"[^\x00-\x7F]"), c).when(single.rlike(r"[^\x00-\x7F]"), several).otherwise(single)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def normalise_name(c: Column) -> Column:
    """Lowercase letters and single spaces: no accents, marks or generational suffix."""
    plain = F.translate(fold_ascii(F.coalesce(c, F.lit(""))), "'.", "")
    bare = F.regexp_replace(plain, f"(?i){SUFFIXES}", " ")
    return squeeze(F.regexp_replace(F.lower(bare), "[^a-z ]", " "))


def apply_aliases(df: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Replace a key by its listed alias; never by a similar one.

    aliases: alias, canonical; one row per alias.
    """
    return (
        df.join(aliases, df[key] == aliases["alias"], "left")
        .withColumn(key, F.coalesce("canonical", key))
        .drop("alias", "canonical")
    )


def alias_rows(spark, extra: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(
        sorted({**ALIASES, **(extra or {})}.items()), "alias string, canonical string"
    )


# -- team codes ------------------------------------------------------------


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def canonical_code(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.when(F.length(c) > 0, F.coalesce(_lookup(CANONICAL_CODES, up), up))


def from_slug(c: Column) -> Column:
    """The code of a slug's last part."""
    last = F.element_at(F.split(F.translate(F.lower(F.trim(c)), "_", "-"), "-"), -1)
    return F.when(F.length(c) > 0, _lookup(NICKNAMES, last))


def from_display(c: Column) -> Column:
    """A trailing three-letter code, else the last word that is a known nickname."""
    tail = F.element_at(F.split(F.trim(c), r"\s+"), -1)
    words = F.split(F.trim(F.lower(F.regexp_replace(c, "[^A-Za-z ]", " "))), " +")
    known = F.filter(F.reverse(words), lambda w: _lookup(NICKNAMES, w).isNotNull())
    return F.when(tail.rlike("^[A-Z]{3}$"), canonical_code(tail)).otherwise(
        _lookup(NICKNAMES, F.get(known, F.lit(0)))
    )
