"""What several operators share: tables, word bytes, bitmaps of fixed size, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.sources import scratch

#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Words that a task remembers before it starts anew; bounds memory only, results are the same.
CACHED_WORDS = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet, so that callers' extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def alnum_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8 bytes."""
    return [] if text is None else text.encode("utf-8", "replace").translate(WORD_BYTES).split()


class WordHash(dict):
    """64-bit hash of a word, remembered; `codes` never holds more than CACHED_WORDS of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A second scramble, so that the low and high bits are independent of a sum's structure."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def chunks(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about `most` characters each, so that long texts don't pile up."""
    start = size = 0
    for i, t in enumerate(texts):
        if size > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


# --- a set of hashes as bits -------------------------------------------------------------------


def bitmap(df: DataFrame, column: str, log2_bits: int = 26) -> np.ndarray:
    """Bits of the hashes in a column: 2**log2_bits of them whatever the number of rows.

    The bits are united on the executors, a word of 32 at a time; at most 2**(log2_bits - 5) words
    come to the driver. Two bits a hash. Test with `in_bitmap`: false positives only.
    """
    words = np.zeros(1 << (log2_bits - 5), np.uint32)
    h = F.col(column)
    probes = F.array(F.shiftrightunsigned(h, 64 - log2_bits), h.bitwiseAND(F.lit((1 << log2_bits) - 1)))
    bit = df.where(h.isNotNull()).select(F.explode(probes).alias("b"))
    out = bit.groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("v"))
    for r in out.toLocalIterator():
        words[r.w] = r.v
    return words


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = int(np.log2(len(words))) + 5
    out = np.ones(len(h), bool)
    for b in (h >> np.uint64(64 - n), h & np.uint64((1 << n) - 1)):
        out &= (words[(b >> np.uint64(5)).astype(np.int64)] >> (b & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return out


# --- connected components ----------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b: long), comp being one node of its component.

    Each round points every node at its neighbour of least hash, follows pointers twice, and
    contracts the edges; the number of nodes at least halves, so rounds grow with the logarithm of
    the nodes, whatever the shape of the graph. Every round is written to the shared folder.
    Nothing but a row count comes to the driver. Null ends are ignored.
    """
    left = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    left = scratch.written(left, "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.col("node").alias("comp"))
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        to = least.select(F.col("a").alias("x"), F.least(F.col("m"), own)["id"].alias("to"))
        for _ in range(2):
            up = to.select(F.col("x").alias("to"), F.col("to").alias("up"))
            to = to.join(up, "to").select("x", F.col("up").alias("to"))
        to = scratch.written(to, "pointers")
        labels = labels.join(to, labels.comp == to.x, "left").select("node", F.coalesce("to", "comp").alias("comp"))
        left = left.join(to.toDF("a", "ta"), "a").join(to.toDF("b", "tb"), "b").where("ta <> tb")
        left = scratch.written(left.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        labels = scratch.written(labels, "labels")
    return labels

