"""Maximal periodic runs of words: a suffix automaton, and link-cut access to its tree of suffix links.

The strings that end at word i are the path from the root of that tree to the state of the i-th prefix.
Paths are kept as in a link-cut tree: every preferred path is a splay tree and has one colour, the
place where its strings ended last. Accessing the state of prefix i meets the segments of other
colours j; the longest string of such a segment has some length L and ends at j and at i, so
where i - j <= L the words i - j - L + 1 .. i have period i - j: a square, and more where L is longer. The
period found is the smallest, since a root of a smaller one would have ended later than j. L is as
long as the words go, so the stretch can't begin earlier; it is a run if the next word breaks it.

Only stretches of words where sequences recur nearby go through the automaton: in a run of period q every
sequence of `window` words has an equal one q words away, and q is at most the stretch by the
least exponent. That test uses hashes and may let too much pass, never too little.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import common as K

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Characters of text handled at once; it changes no result.
AT_ONCE = 2_000_000


class Automaton:
    """The suffix automaton of a sequence of small integers: `length`, `link`, and the state of each prefix.

    Most states have one successor, so the first one is kept in arrays and others in tables.
    """

    def __init__(self, words: list[int]):
        most = 2 * len(words) + 1
        self.length, self.link = array("i", bytes(4 * most)), array("i", bytes(4 * most))
        self.word, self.to, self.more = array("i", [-1]) * most, array("i", bytes(4 * most)), {}
        self.link[0] = -1
        self.size, self.prefix = 1, array("i")
        last = 0
        for w in words:
            last = self.append(last, w)
            self.prefix.append(last)

    def follow(self, state: int, w: int) -> int:
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return more.get(w, -1) if more else -1

    def lead(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def append(self, last: int, w: int) -> int:
        length, link, follow = self.length, self.link, self.follow
        new = self.size
        self.size += 1
        length[new] = length[last] + 1
        p = last
        while p >= 0 and (q := follow(p, w)) < 0:
            self.lead(p, w, new)
            p = link[p]
        if p < 0:
            link[new] = 0
        elif length[q] == length[p] + 1:
            link[new] = q
        else:
            part = self.size
            self.size += 1
            length[part], link[part] = length[p] + 1, link[q]
            self.word[part], self.to[part] = self.word[q], self.to[q]
            if q in self.more:
                self.more[part] = dict(self.more[q])
            while p >= 0 and follow(p, w) == q:
                self.lead(p, w, part)
                p = link[p]
            link[q] = link[new] = part
        return new


class Paths:
    """Preferred paths of a tree given by parents, as splay trees ordered from the root down."""

    def __init__(self, parent: array, size: int):
        self.up = array("i", parent[:size])
        self.left, self.right = array("i", [-1]) * size, array("i", [-1]) * size
        #: Valid at the top of a splay tree: the colour of its whole path, -1 before its first access.
        self.colour = array("i", [-1]) * size

    def splay(self, x: int) -> None:
        """Bring x to the top of its splay tree."""
        up, left, right = self.up, self.left, self.right
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            on_left = left[p] == x
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if inner and on_left == (left[g] == p):
                self.turn(p, g)
            elif inner:
                self.turn(x, p)
                p = g
            if up[x] == p:
                self.turn(x, p)

    def turn(self, x: int, p: int) -> None:
        """Turn x above its parent p."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        g = up[p]
        if g >= 0 and left[g] == p:
            left[g] = x
        elif g >= 0 and right[g] == p:
            right[g] = x
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c >= 0:
            up[c] = p
        up[p], up[x] = x, g
        colour[x] = colour[p]

    def access(self, state: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from `state` to the root; (old colour, deepest state) of its segments, deepest first."""
        met = []
        below, x = -1, state
        while x >= 0:
            self.splay(x)
            old = self.colour[x]
            if old >= 0:
                met.append((old, x))
            cut = self.right[x]
            if cut >= 0:
                self.colour[cut] = old
            self.right[x] = below
            self.colour[x] = colour
            below, x = x, self.up[x]
        return met


def runs(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of a sequence, by start and period.

    A run has its smallest period q, a length of at least `min_length` and `min_exponent` (2 or more) times q, and no
    neighbour that continues the period.
    """
    number: dict = {}
    codes = [number.setdefault(w, len(number)) for w in words]
    automaton = Automaton(codes)
    paths = Paths(automaton.link, automaton.size)
    length, n, out = automaton.length, len(codes), []
    for i, state in enumerate(automaton.prefix):
        for j, deepest in paths.access(state, i):
            period, common = i - j, length[deepest]
            if period <= common and period + common >= max(min_length, min_exponent * period):
                if i + 1 == n or codes[i + 1] != codes[i + 1 - period]:
                    out.append((i - period - common + 1, period + common, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def window(min_length: int, min_exponent: int) -> int:
    """The least number of words of a run that recur one period later."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))


def stretches(codes: np.ndarray, text: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """(start, end) of stretches of words that may hold runs; `codes` are hashes, `text` numbers each word's text."""
    m = window(min_length, min_exponent)
    places = len(codes) - m + 1
    if places <= 0:
        return []
    h = text[:places].astype(np.uint64)
    for k in range(m):
        h = (h ^ codes[k : k + places]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    gap = np.where(same, order[1:] - order[:-1], places)
    near = np.full(places, places)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    # Windows over the end of a text belong to none.
    at = np.flatnonzero((near < places) & (text[:places] == text[m - 1 :]))
    while len(at):
        apart = np.flatnonzero((np.diff(at) > m) | (np.diff(text[at]) != 0)) + 1
        first, last = np.append(0, apart), np.append(apart, len(at)) - 1
        size = at[last] + m - at[first]
        keep = (near[at] <= np.repeat(size // min_exponent, last - first + 1)) & np.repeat(size >= min_length, last - first + 1)
        if keep.all():
            return list(zip(at[first].tolist(), (at[last] + m).tolist()))
        at = at[keep]
    return []


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join([w for w, d in zip(words, np.cumsum(drop).tolist()) if not d])


SCHEMA = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its periodic runs, and the text without their repetitions.

    Words are what ASCII white space parts. Runs are in order of start, then period; `collapsed` has one period of
    each, words joined by one space. Null, empty and blank texts have no runs and an empty `collapsed`. Repeated rows
    and null ids come as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = K.WordHash()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in K.chunks(texts, AT_ONCE):
                split = [[] if t is None else t.split() for t in texts[a:b]]
                n = np.array([len(w) for w in split])
                found: list[list] = [[] for _ in split]
                start = np.cumsum(n) - n
                codes, owner = memory.codes([w for ws in split for w in ws]), np.repeat(np.arange(len(n)), n)
                for s, e in stretches(codes, owner, min_length, min_exponent):
                    i = int(owner[s])
                    s, e = s - int(start[i]), e - int(start[i])
                    found[i] += [(s + x, y, q) for x, y, q in runs(split[i][s:e], min_length, min_exponent)]
                listed = pa.array([[{"start": x, "length": y, "period": q} for x, y, q in r] for r in found], RUNS)
                kept = pa.array([collapsed(w, r) for w, r in zip(split, found)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), listed, kept], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {SCHEMA}")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where one text in ten, chosen by its id, is made periodic from one of its words on.

    With h = crc32 of the decimal id and g = h / 10: if h % 10 = 0, word i >= a = g % n of n words becomes word
    a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8), in whole numbers. Null ids and texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.expr("case when n > 0 then (h div 10) % n end"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    edited = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of the runs and of the collapsed text, from the result of `detect`."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return out.select(
        "doc_id", "n_runs", *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
