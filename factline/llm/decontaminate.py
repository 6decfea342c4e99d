"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: hashed where the mask has a 1, ignored where it has a
0. Seeds of benchmark items and of documents are joined by hash; every hit names an alignment of a
document with an item, and the alignment is verified word by word with substitutions allowed.

A document is contaminated by an item if some ungapped alignment has WINDOW consecutive words of
which at most MISSES differ. The masks are chosen so that every such window has a seed without a
miss (all 92 patterns of misses are checked in the tests), so none is lost. An item of fewer words
than WINDOW must occur whole, without a miss; an item without words occurs nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import common as K
from factline.sources import scratch

MASKS = ("11101011", "11001111")
WINDOW = 13
MISSES = 2


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the seed at each place of `words` where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask) * 1_000_003 + int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return K.mix(h)


def item_seeds(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, words, hash, at) of every seed of every item; short items have one, of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = K.WordHash()
        for batch in batches:
            out: list[tuple] = []
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = memory.codes(K.alnum_words(t))
                masks = MASKS if len(words) >= WINDOW else ("1" * len(words),) if len(words) else ()
                for mask in masks:
                    out += [(item, words.astype(np.int64), h, i) for i, h in enumerate(seed_hashes(words, mask).astype(np.int64).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.list_(pa.int64())), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int32())],
                names=["item", "words", "hash", "at"],
            )

    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    return rows.mapInArrow(run, "item long, words array<long>, hash long, at int")


def text_seeds(docs: DataFrame, bits: np.ndarray, masks: tuple[str, ...]) -> DataFrame:
    """(h, words, hashes, places) of texts with seeds whose bits are set; `h` stands for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = K.WordHash()
        for batch in batches:
            keys, texts = batch.column("h").to_pylist(), batch.column("text").to_pylist()
            for a, b in K.chunks(texts):
                split = [K.alnum_words(t) for t in texts[a:b]]
                ends = np.cumsum([len(w) for w in split])
                codes = memory.codes([w for ws in split for w in ws])
                # All seeds of the chunk at once; those that cross from one text into the next are dropped.
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for mask in masks:
                    hashes = seed_hashes(codes, mask)
                    at = np.flatnonzero(K.in_bitmap(bits, hashes))
                    doc = np.searchsorted(ends, at, "right")
                    inside = at + len(mask) <= ends[np.minimum(doc, len(ends) - 1)] if len(at) else np.zeros(0, bool)
                    found.append((at[inside], hashes[at[inside]]))
                at = np.concatenate([x for x, _ in found])
                if not len(at):
                    continue
                hashes = np.concatenate([x for _, x in found])
                doc = np.searchsorted(ends, at, "right")
                order = np.lexsort((at, doc))
                at, hashes, doc = at[order], hashes[order], doc[order]
                hit, first = np.unique(doc, return_index=True)
                bounds = [*first.tolist(), len(doc)]
                starts = np.concatenate([[0], ends])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[a + d] for d in hit], pa.int64()),
                        pa.array([codes[starts[d] : ends[d]].astype(np.int64) for d in hit], pa.list_(pa.int64())),
                        pa.array([hashes[i:j].astype(np.int64) for i, j in zip(bounds, bounds[1:])], pa.list_(pa.int64())),
                        pa.array([(at[i:j] - starts[d]).astype(np.int32) for d, i, j in zip(hit, bounds, bounds[1:])], pa.list_(pa.int32())),
                    ],
                    names=["h", "words", "hashes", "places"],
                )

    return docs.select(F.xxhash64("text").alias("h"), "text").where("text is not null").mapInArrow(run, "h long, words array<long>, hashes array<long>, places array<int>")


def best_window(equal: np.ndarray, n_item: int) -> tuple[int, int, int]:
    """(start, words, equal words) of the longest run of accepted windows, or (-1, 0, 0)."""
    w = min(WINDOW, n_item)
    if not w or len(equal) < w:
        return -1, 0, 0
    misses = MISSES if n_item >= WINDOW else 0
    total = np.concatenate([[0], np.cumsum(equal)])
    good = np.concatenate([[0], (total[w:] - total[:-w] >= w - misses).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(good))
    if not len(edges):
        return -1, 0, 0
    runs = [(int(b - a + w - 1), -int(a)) for a, b in zip(edges[::2], edges[1::2])]
    length, start = max(runs)
    return -start, length, int(total[length - start] - total[-start])


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(h, item, at, item_at, words, equal): for each text hash and item its longest verified overlap.

    `h` is xxhash64 of the text: equal texts share one row. Places count words from 0. Items with a
    null id or text are ignored; so are documents without text. Documents are read once and only
    those with a seed in the benchmark's bitmap (of fixed size) move.
    """
    seeds = scratch.written(item_seeds(items, item_id, item_text), "item-seeds")
    bits = K.bitmap(seeds, "hash")
    short = [r.n for r in seeds.select(F.size("words").alias("n")).where(F.col("n") < WINDOW).distinct().collect()]  # fewer than WINDOW numbers
    masks = (*MASKS, *("1" * n for n in sorted(short)))
    hits = scratch.written(text_seeds(docs.select(F.col(text).alias("text")), bits, masks).dropDuplicates(["h"]), "seed-hits")
    places = hits.select("h", F.explode(F.arrays_zip("hashes", "places")).alias("p")).select("h", F.col("p.hashes").alias("hash"), F.col("p.places").alias("place"))
    aligned = places.join(seeds.select("hash", "item", "at"), "hash").select("h", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    words = seeds.groupBy("item").agg(F.first("words").alias("item_words"))
    # A document's words are read once for all its alignments, and only the part beside an item goes on.
    sized = aligned.join(words.select("item", F.size("item_words").alias("n_item")), "item")
    asked = sized.groupBy("h").agg(F.collect_list(F.struct("item", "shift", "n_item")).alias("asked"))

    def cut(a):
        d, i = F.greatest(a["shift"], F.lit(0)), F.greatest(-a["shift"], F.lit(0))
        part = F.slice("words", d + 1, a["n_item"] - i)
        return F.struct(a["item"].alias("item"), d.alias("d"), i.alias("i"), a["n_item"].alias("n_item"), part.alias("x"))

    cuts = hits.select("h", "words").join(asked, "h").select("h", F.inline(F.transform("asked", cut)))
    both = cuts.join(words, "item").select("h", "item", "d", "i", "n_item", "x", F.slice("item_words", F.col("i") + 1, F.col("n_item")).alias("y"))

    @F.pandas_udf("at int, words int, equal int")
    def verified(x, y, n):
        import pandas as pd

        out = []
        for a, b, m in zip(x, y, n):
            k = min(len(a), len(b))
            out.append(best_window(np.asarray(a[:k]) == np.asarray(b[:k]), m))
        return pd.DataFrame(out, columns=["at", "words", "equal"])

    checked = both.select("h", "item", "d", "i", verified("x", "y", "n_item").alias("v")).where("v.at >= 0")
    row = F.struct(F.col("v.words").alias("words"), F.col("v.equal").alias("equal"), (-(F.col("d") + F.col("v.at"))).alias("neg_at"), (F.col("i") + F.col("v.at")).alias("item_at"))
    best = checked.groupBy("h", "item").agg(F.max(row).alias("b"))
    return best.select("h", "item", (-F.col("b.neg_at")).alias("at"), F.col("b.item_at").alias("item_at"), F.col("b.words").alias("words"), F.col("b.equal").alias("equal"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, contaminated, n_items, item_ids, first_word, n_equal.

    Null or empty texts and texts of an empty benchmark are clean. Repeated rows stay repeated.
    """
    per_text = overlaps(docs, items).groupBy("h").agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.min("at").cast("long").alias("first_word"), F.max("equal").cast("long").alias("n_equal")
    )
    thin = docs.select("doc_id", F.xxhash64("text").alias("h"))
    return thin.join(per_text, "h", "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"),
        "first_word",
        F.coalesce("n_equal", F.lit(0)).cast("long").alias("n_equal"),
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that no item contaminates."""
    bad = overlaps(docs, items, text).select("h").distinct()
    key = K.free_name(docs, "_h")
    return docs.withColumn(key, F.xxhash64(F.col(text))).join(bad.withColumnRenamed("h", key), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
