"""N-gram Jaccard join: the product of the document by n-gram incidence with its transpose, in blocks.

Documents link when 100 * intersection >= 75 * union of their sets of five-word shingles. The matrix
has a row for each distinct set and a column for each shingle; an entry of the product is an overlap.

- Columns are ordered from rare to frequent by a frequency sketch of all shingles (a table of fixed
  size), then by hash. For any order, two sets that link have a column in common among the first
  n - ceil(3n/4) + 1 of each, so only those entries are multiplied. Frequent columns (licence
  lines, shared passages) come last and are hardly ever among them.
- A block is a column, or a part of one if the sketch says that it is large. First every row meets one
  row only of each of its blocks, its head; counts of common entries add up, and pairs whose count plus what is
  left of either row can't reach the bound given by their sizes are discarded.
- Verified links make components. Then rows of a block that are still in different components meet, with the
  same bounds and once a pair, so no link between components is lost, while a group of thousands of
  near copies costs about one pair a row instead of all its pairs.

Shingles are 64-bit hashes, columns 56 of their bits, and sets are compared by 48, so within a pair a chance
match of two shingles is one in some million pairs of long texts. A row of the matrix goes by a 64-bit hash of its
set over the whole corpus: by the birthday bound one in 10**9 sets or so may share it by chance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.llm import common as K
from factline.sources import scratch

SHINGLE = 5
LOG2_SKETCH = 21
PARTS = 64
#: Rows of a column, by the sketch, from which on its block is split.
BLOCK = 2048
#: First columns of a node that its entries carry, so that a pair comes up once.
LEAD = 8
#: Characters of text whose shingles are held at once, and keys remembered; they change no result.
AT_ONCE = 1_000_000
REMEMBERED = 200_000
#: Bytes of a shingle's hash that sets are compared by.
KEPT = 6
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LOW56 = np.uint64((1 << 56) - 1)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return [] if text is None else text.encode("utf-8", "replace").translate(LOWER).split()


def shingles(texts: list[str | None], memory: K.WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the shingles of all texts in turn, repeated ones too, and where each text's end."""
    split = [words_of(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    codes = memory.codes([w for ws in split for w in ws])
    if len(codes) >= SHINGLE:
        m = len(codes) - SHINGLE + 1
        h = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            h = (h ^ codes[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        h = K.mix(h)
    else:
        h = np.zeros(0, np.uint64)
    full = np.maximum(n - SHINGLE + 1, 0)
    start = np.cumsum(n) - n
    out_n = np.where(n >= SHINGLE, full, (n > 0).astype(np.int64))
    ends = np.cumsum(out_n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    long = np.repeat(n >= SHINGLE, out_n)
    offset = np.arange(len(out)) - np.repeat(ends - out_n, out_n)
    at = np.repeat(start, out_n) + offset
    out[long] = h[at[long]]
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        out[ends[i] - 1] = xxhash.xxh64_intdigest(b" ".join(split[i]), seed=len(split[i]))
    return out, ends


def sketch(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often shingles of each of 2**LOG2_SKETCH classes occur in all texts.

    Every task counts its own texts and sends PARTS packed pieces; pieces are added up by sixteen tasks, then
    by sixteen of those, then all. The table that comes to the driver has the same size for any input.
    """
    width = 1 << LOG2_SKETCH

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, total = K.WordHash(), np.zeros(width, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in K.chunks(texts, AT_ONCE):
                h, _ = shingles(texts[a:b], memory)
                total += np.bincount((h >> np.uint64(64 - LOG2_SKETCH)).astype(np.int64), minlength=width)
        if total.any():
            parts = [packed(x) for x in np.split(total, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"][:1], "step": pdf["step"][:1], "counts": [packed(sum(map(unpacked, pdf["counts"])))]})

    kind = "part int, step int, counts binary"
    pieces = docs.select(text).mapInArrow(count, "part int, counts binary").withColumn("step", F.spark_partition_id())
    for by in (16, 16):
        pieces = pieces.withColumn("step", F.floor(F.col("step") / by).cast("int")).groupBy("part", "step").applyInPandas(add, kind)
    out = np.zeros(width, np.int64)
    for r in pieces.groupBy("part").applyInPandas(add, kind).toLocalIterator():
        out[r.part * (width // PARTS) : (r.part + 1) * (width // PARTS)] = unpacked(r.counts)
    return out


def packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, the type's width first."""
    narrow = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    return bytes([narrow.itemsize]) + zlib.compress(narrow.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").astype(np.int64)


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """One of 256 classes of a frequency; higher is more frequent."""
    return np.minimum(8 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)


def prefix_length(n: int) -> int:
    """How many of the first columns of a row of n must hold one that is common with any linked row."""
    return n - (3 * n + 3) // 4 + 1 if n else 0


def ordered_sets(texts: list[str | None], classes: np.ndarray, memory: K.WordHash) -> list[np.ndarray]:
    """Each text's set: class in the highest 8 bits, 56 bits of hash below, ascending."""
    h, ends = shingles(texts, memory)
    c = (classes[(h >> np.uint64(64 - LOG2_SKETCH)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h & LOW56)
    start = 0
    out = []
    for e in ends.tolist():
        out.append(np.unique(c[start:e]))
        start = e
    return out


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def rows_of(docs: DataFrame, classes: np.ndarray, text: str) -> DataFrame:
    """(doc_id, key, node, n, prefix) of every row; `node` stands for the set, `key` for id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = K.WordHash()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in K.chunks(texts, AT_ONCE):
                sets = ordered_sets(texts[a:b], classes, memory)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(a, b - a) for c in ("doc_id", "key")),
                        pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s[: prefix_length(len(s))].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "node", "n", "prefix"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col(text)).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, node long, n long, prefix array<long>")


def incidence(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(col, salt, node, n, pos, head, head_pos, parted) of entries in blocks that more than one node shares.

    A block's head is the node that has fewest rarer columns than the block's: of near copies of a text,
    the one with the fewest changes. `parted` says that the column is split over several blocks. Copies
    within a task are left out before the one shuffle, those of other tasks after it.
    """
    # By class: into how many parts a column of that class is split. 256 numbers.
    splits = [max(1, int(2 ** (c / 8) // BLOCK)) for c in range(256)]
    split = F.get(F.array(*[F.lit(x) for x in splits]), F.shiftrightunsigned("col", 56).cast("int"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keep = []
            for x in batch.column("node").to_pylist():
                keep.append(x not in seen)
                seen.add(x)
            if len(seen) > REMEMBERED:
                seen = set()
            yield batch.filter(pa.array(keep))

    entries = rows.where("n > 0").select("node", "n", "prefix").mapInArrow(once, "node long, n long, prefix array<long>")
    entries = entries.select("node", "n", F.posexplode("prefix").alias("pos", "col"))
    entries = entries.withColumn("salt", F.pmod("node", split))
    block = Window.partitionBy("col", "salt")
    entries = entries.select("col", "salt", "node", F.col("n").cast("int").alias("n"), "pos", (split > 1).alias("parted"))
    entries = entries.withColumn("lo", F.min("node").over(block)).withColumn("hi", F.max("node").over(block)).withColumn("first", F.min(F.struct("pos", "node")).over(block))
    shared = entries.where("lo < hi or parted")
    return shared.select("col", "salt", "node", "n", "pos", F.col("first.node").alias("head"), F.col("first.pos").alias("head_pos"), "parted").distinct()


def needed(na, nb) -> F.Column:
    """The least overlap with which sets of these sizes link: 7 * overlap >= 3 * (na + nb)."""
    return F.ceil((na + nb) * 3 / 7)


def possible(na, nb) -> F.Column:
    """Sizes with which sets can link at all."""
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb))


def lists_of(entries: DataFrame, *more: str) -> DataFrame:
    """(node, n, s): each node's entries in order, s an array of (pos, col and `more`)."""
    return entries.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "col", *more))).alias("s"))


def kept_pairs(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that can reach the bound given by their sizes.

    The entries that both lists have in common count; after the last of them at most as many more columns
    can be common as either row has left.
    """
    of = lambda side: lists.select(
        F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("s.col").alias(f"c{side}"), F.col("s.pos").alias(f"p{side}")
    )
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(possible(F.col("na"), F.col("nb"))).withColumn("shared", F.array_intersect("ca", "cb"))
    last = lambda side: F.get(f"p{side}", (F.array_position(f"c{side}", F.element_at("shared", -1)) - 1).cast("int"))
    left = F.least(F.col("na") - last("a"), F.col("nb") - last("b")) - 1
    enough = F.size("shared") + left >= needed(F.col("na"), F.col("nb"))
    return both.where((F.size("shared") > 0) & enough).select("a", "b")


def sets_of(docs: DataFrame, rows: DataFrame, pairs: DataFrame, classes: np.ndarray, text: str) -> DataFrame:
    """(node, set) of the nodes of `pairs`: only rows whose key is in a bitmap of fixed size are read again.

    A node's set is taken from the row of least key. What else the bitmap lets through, and a second
    copy where a row is repeated, joins with nothing or says the same again.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = rows.select("node", "key").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    bits = K.bitmap(wanted, "key", 25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen = K.WordHash(), set()
        for batch in batches:
            key = np.asarray(batch.column("key"), np.int64)
            hit = [i for i in np.flatnonzero(K.in_bitmap(bits, key.astype(np.uint64))) if not (key[i] in seen or seen.add(key[i]))]
            if len(seen) > REMEMBERED:
                seen = set()
            texts = batch.column("text").take(pa.array(hit, pa.int64())).to_pylist()
            for a, b in K.chunks(texts, AT_ONCE):
                sets = ordered_sets(texts[a:b], classes, memory)
                ids = [node_of(s) if len(s) else None for s in sets]
                packed = [s.view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["node", "set"])

    again = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col(text)).alias("key"), F.col(text).alias("text")).where("text is not null")
    return scratch.written(again.mapInArrow(run, "node long, set binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs that link, by the overlap of their whole sets."""

    @F.pandas_udf("boolean")
    def links(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: bytes, q: bytes) -> bool:
            na, nb = len(p) // KEPT, len(q) // KEPT
            u = np.zeros((na + nb, 8), np.uint8)
            u[:na, :KEPT] = np.frombuffer(p, np.uint8).reshape(-1, KEPT)
            u[na:, :KEPT] = np.frombuffer(q, np.uint8).reshape(-1, KEPT)
            v = np.sort(u.view(np.uint64).ravel())
            common = int((v[1:] == v[:-1]).sum())
            return 100 * common >= 75 * (na + nb - common)

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype=bool)

    both = pairs.select("a", "b").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.where(links("x", "y")).select("a", "b")


def star_links(entries: DataFrame) -> DataFrame:
    """Each node with the one partner, among the heads of its blocks, that shares most entries.

    Of these pairs, those that can reach their bound.
    """
    # A split column's parts are tied by the head of the whole column.
    heads = entries.where("parted").select("col", "salt", F.struct("head_pos", "head").alias("h")).distinct()
    whole = heads.groupBy("col").agg(F.min("h").alias("w"))
    tied = heads.join(whole, "col").where("h.head <> w.head").select(F.col("h.head").alias("a"), F.col("w.head").alias("b"))
    met = entries.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    counts = met.union(tied).groupBy("a", "b").agg(F.count("*").alias("common"))
    best = scratch.written(counts.groupBy("a").agg(F.max_by("b", F.struct("common", "b")).alias("b")), "partners")
    return scratch.written(kept_pairs(best, scratch.written(lists_of(entries), "lists")), "star-links")


def mixed_columns(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of columns that several components share, with `comp` and the head's component `main`."""
    own = entries.select("col", "node", "n", "pos").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    main = own.groupBy("col").agg(F.min_by("comp", F.struct("pos", "node")).alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return scratch.written(own.join(main.where("lo < hi").select("col", "main"), "col"), "mixed-columns")


def other_links(mixed: DataFrame) -> DataFrame:
    """Pairs of nodes of one column that are in different components so far and can reach their bound.

    Entries meet by column and are thin: beside their own place they carry the first LEAD columns that
    their node has in this table. Where those of two nodes have one in common, the pair comes up only there;
    else at every column in common, and once more is taken as once. Each pair's whole lists of
    columns are then fetched one time, for its count and what can still follow the last one.
    """
    listed = scratch.written(lists_of(mixed, "comp", "main"), "column-lists")
    entries = listed.select("node", "n", F.slice("s.col", 1, LEAD).alias("lead"), F.inline("s"))
    # Members of a column's main component have nothing to ask each other.
    a, b = entries.where("comp <> main").alias("a"), entries.alias("b")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    apart = (x("comp") != y("comp")) & ((y("comp") == y("main")) | (x("node") < y("node")))
    reach = F.least(x("n") - x("pos"), y("n") - y("pos")) >= needed(x("n"), y("n"))
    shared = F.array_intersect(x("lead"), y("lead"))
    here = F.coalesce(F.get(shared, F.lit(0)) == x("col"), F.lit(True))
    met = a.join(b, (x("col") == y("col")) & apart & possible(x("n"), y("n")) & reach & here)
    pairs = met.select(F.least(x("node"), y("node")).alias("a"), F.greatest(x("node"), y("node")).alias("b")).distinct()
    pairs = scratch.written(pairs, "candidates")
    return scratch.written(kept_pairs(pairs, listed), "other-links")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, component_id, comp for every row of `docs` (key: hash of id and text).

    component_id is the least doc_id reachable by links, the document itself included. Null, empty
    and blank texts have no shingle and link with nothing, not even each other; repeated rows of an
    id share its component. A null id links like any other and takes the least id of its component,
    or null. `comp` stands for the component, also of rows with null ids only; it is null without
    shingles. Other columns are ignored. The result is exact for any group size.
    """
    classes = frequency_class(sketch(docs, text))
    rows = scratch.written(rows_of(docs, classes, text), "shingle-rows")
    entries = scratch.written(incidence(rows, classes), "incidence")
    check = lambda pairs: scratch.written(verified(pairs, sets_of(docs, rows, pairs, classes, text)), "links")
    links = check(star_links(entries))
    labels = K.components(links)
    more = check(other_links(mixed_columns(entries, labels)))
    if not more.isEmpty():
        labels = K.components(links.union(more))
    own = rows.select("doc_id", "key", "node", F.col("n").alias("n_shingles")).join(labels, "node", "left")
    own = own.withColumn("comp", F.coalesce("comp", "node"))
    least = own.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = own.join(least, "comp", "left")
    return out.select("doc_id", "key", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "comp")


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row, all columns, of each group of rows that link: the one with the least id, then the least hash.

    A null id comes after all others. Rows of one id whose texts don't link are different groups, so each
    keeps a row. Rows without words stay, one for each id and text.
    """
    found = near_duplicates(docs, text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = found.where("comp is not null").groupBy("comp").agg(first).select(F.col("first.key").alias("key"))
    kept = kept.union(found.where("comp is null").select("key"))
    key = K.free_name(docs, "_key")
    marked = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col(text)))
    rows = marked.join(kept.select(F.col("key").alias(key)), key, "left_semi").dropDuplicates([key])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
