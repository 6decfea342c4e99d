"""Token ids in ORC: stripes with integer run lengths, row indexes, Bloom filters on document ids.

Documents are range-partitioned by id, so every file holds one range and every stripe a narrower
one; readers split files at stripes, and a filter on the id skips stripes and row groups by their
minima, maxima and Bloom filters.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factline.llm import common as K
from factline.sources import scratch

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: What Python takes for white space and the tokenizer doesn't, and marks that may compose with A-Z.
SEPARATORS = "\x1c\x1d\x1e\x1f"
COMBINING = re.compile("[\u0300-\u036f]")
WORDS_AT_ONCE = 1_000
#: Words of letters that neither lower-casing nor composing changes, and marks after them.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
END = "\x00"
#: Pieces that a Python worker remembers before it starts anew; bounds memory only.
MEMORY = 500_000


def _quick(vocab: dict[str, int], special: set[str]):
    """The same merges over bytes. A word ends with END, a byte that no plain word holds: it joins the last byte
    before anything else does, as the ids of those tokens come first, and so stands for the mark of a word's end."""
    import tiktoken

    # The file writes every byte as one character: the printable ones as themselves, the rest in turn from 256 on.
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    end = END.encode()
    ranks = {bytes(byte[c] for c in t.removesuffix("</w>")) + end * t.endswith("</w>"): i for t, i in vocab.items() if t not in special}
    single = [i for t, i in ranks.items() if len(t) == 1]
    closed = [i for t, i in ranks.items() if len(t) == 2 and t[1:] == end]
    assert len(single) == 256 and max(single) < min(closed) and max(closed) < min(i for t, i in ranks.items() if len(t) > 2)
    return tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """The tokenizer's ids of whole texts, with a memory of pieces.

    The tokenizer lower-cases, drops white space, never joins across it, and splits letters from
    marks; so a text's ids are those of its pieces in order. The memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.quick = _quick(vocab, {t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.count, self.ids = array("q"), array("i")

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces: plain words, with marks after them or without, by the quick encoder, others one by one."""
        plain, other, parts = [], [], []
        for p in pieces:
            m = PLAIN.fullmatch(p)
            if m:
                plain.append(p)
                parts.append(f"{p}{END}" if m.end(1) == len(p) else f"{m[1]}{END}{m[2]}{END}")
            else:
                other.append(p)
        if plain:
            ids = np.array(self.quick.encode_ordinary("".join(parts)), np.int32)
            # A word ends with the last of its tokens; marks after it are one more word.
            words = np.fromiter((x.count(END) for x in parts), np.int64, len(parts))
            last = np.flatnonzero(self.ends[ids])[np.cumsum(words) - 1]
            self._keep(plain, ids.tolist(), np.diff(last, prepend=-1).tolist())
        for s in range(0, len(other), WORDS_AT_ONCE):
            got = self._encode(other[s : s + WORDS_AT_ONCE])
            self._keep(other[s : s + WORDS_AT_ONCE], [i for ids in got for i in ids], list(map(len, got)))

    def _keep(self, pieces: list[str], ids: list[int], counts: list[int]) -> None:
        at = len(self.count)
        self.known.update(zip(pieces, range(at, at + len(pieces))))
        self.count.extend(counts)
        self.ids.extend(ids)

    @staticmethod
    def pieces(text: str | None) -> list[str]:
        if not text:
            return []
        # Lower-casing A-Z first saves memory; it must touch neither special tokens nor letters that compose.
        if "<|" not in text:
            if text.isascii():
                text = text.lower()
            elif not COMBINING.search(text):
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        if any(c in text for c in SEPARATORS):
            return [p for p in re.split("[ \n\r\t]+", text) if p]
        return text.split()

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in one array, number of ids of each text); `end` closes every text."""
        if len(self.known) > MEMORY:
            self.clear()
        flat: list[str | None] = []
        ends = []
        for t in texts:
            flat += self.pieces(t)
            flat.append(None)
            ends.append(len(flat))
        known = self.known
        self.learn(list({*flat}.difference(known, (None,))))
        known[None] = len(self.count)
        index = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        del known[None]
        count = np.append(np.frombuffer(self.count, np.int64), 1)
        ids = np.append(np.frombuffer(self.ids, np.int32), np.int32(end))
        start = np.cumsum(count) - count
        n = count[index]
        shift = np.repeat(start[index] - (np.cumsum(n) - n), n)
        out = ids[shift + np.arange(len(shift))]
        total = np.concatenate([[0], np.cumsum(n)])[ends]
        return out, np.diff(total, prepend=0)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker: reading the vocabulary costs more than a small task."""
    return Encoder(path)


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END_ID) -> DataFrame:
    """(doc_id, ids) of every row; null texts are empty, so they hold the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        own = encoder(public_tokenizers.path(tokenizer))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in K.chunks(texts, 1_000_000):
                flat, n = own.encode(texts[a:b], end)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END_ID, stripe_bytes: int = 16 << 20, files: int | None = None) -> None:
    """Encode `docs` (doc_id, text) and write them as ORC at `path`, in ascending doc_id order.

    File names ascend with the ids (null ids first; equal ids in any order, split over files where
    there are many). Texts move once, by ranges; the rest of the job is local to a range.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(files, "doc_id", "_tie", "_row").sortWithinPartitions("doc_id", "_tie", "_row")
    (
        encoded(rows, tokenizer, end)
        .write.option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", 1_000)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids); with `doc_ids`, only stripes and row groups that may hold them are read."""
    df = spark.read.schema("doc_id long, ids array<int>").orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files at `path`.

    Files are read by stripes in parallel; ids before a document are those of earlier files (a sum
    over one row a file) and of earlier rows of its own.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(), "<u4")
            crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(at, at[1:])], pa.int64())
            n = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "block", "at", "doc_id")), n, crc], names=["file", "block", "at", "doc_id", "n_tokens", "ids_crc32"])

    # The writer numbers files in the order of its ranges; a file's splits start at different bytes.
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    rows = read(spark, path).select(number.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "doc_id", "ids")
    rows = scratch.written(rows.mapInArrow(sums, "file long, block long, at long, doc_id long, n_tokens long, ids_crc32 long"), "token-sums")
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = per_file.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "block", "at")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")

