"""Places of pattern matches in texts, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions.folds import bind, running

SPAN = "array<struct<s:int,e:int,m:string>>"
NONE = "array<struct<s:int,k:int,e:int,m:string>>"


def matches(text, pattern: str, guard=None) -> F.Column:
    """(s, e, m) of the leftmost non-overlapping matches of a pattern that never matches nothing.

    Places are code points from 0, the end exclusive. Matches and the texts between them alternate, so
    a running sum of their lengths is where each stands. `guard` is a cheap condition without
    which nothing matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("g"))

    def step(at, x):
        s = at + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("state"), F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")).alias("out"))

    # The last piece has no match after it.
    placed = running(F.filter(steps, lambda x: x["m"].isNotNull()), F.lit(0), step, SPAN[6:-1])
    sure = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(sure, placed).otherwise(F.array().cast(SPAN))


def of_kind(found, k: int) -> F.Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))


def joined(spans, kinds: tuple[str, ...]) -> F.Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count(spans, k: int) -> F.Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def free(found, base) -> F.Column:
    """Spans that no span of `base` overlaps, by start.

    In order of start, a span is clear of base spans before it if it starts where they have ended, and of
    those after it if it ends before the next one starts: two passes over both.
    """
    both = "s:int,last:boolean,e:int,k:int,m:string,free:boolean"
    tagged = lambda spans, own: F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("last"), x["e"].alias("e"), x["k"].alias("k"), x["m"].alias("m"), F.lit(True).alias("free"))
    )

    def ahead(ended, x):
        out = F.struct(x["s"], x["last"], x["e"], x["k"], x["m"], (x["s"] >= ended).alias("free"))
        return F.struct(F.when(x["last"], ended).otherwise(F.greatest(ended, x["e"])).alias("state"), out.alias("out"))

    def back(begins, x):
        out = F.struct(x["s"], x["last"], x["e"], x["k"], x["m"], (x["free"] & (x["e"] <= begins)).alias("free"))
        return F.struct(F.when(x["last"], begins).otherwise(x["s"]).alias("state"), out.alias("out"))

    def clear(own):
        spans = running(F.array_sort(F.concat(tagged(own["base"], False), tagged(own["found"], True))), F.lit(0), ahead, f"struct<{both}>")
        spans = F.reverse(running(F.reverse(spans), F.lit(2**31 - 1), back, f"struct<{both}>"))
        kept = F.filter(spans, lambda x: x["last"] & x["free"])
        return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["m"].alias("m")))

    return bind(
        F.struct(found.alias("found"), base.alias("base")),
        lambda own: F.when((F.size(own["found"]) == 0) | (F.size(own["base"]) == 0), own["found"]).otherwise(clear(own)),
    )
