"""Alignment of two tokenizers: sparse products of token incidence matrices over a text's bytes.

Tokenizer A is byte-level, tokenizer B cuts pieces; both read a text with a space before it. Row i of
a byte incidence matrix has a one in the columns of the bytes that token i covers. The product
A · Bᵀ, a row at a time, has an entry for every two tokens that overlap, its value being the bytes
they share. Byte places where tokens of both end cut the text into groups; tokens by groups is a
second incidence matrix, and its product links all tokens of a group.

Two tokens that end together cover the same bytes back from there, so the shorter one's bytes end the
longer one's. Hence the pairs of ids that can ever end together follow from the vocabularies: at most
as many as their tokens have bytes, whatever the corpus. Counts of pairs are an array of that size.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import pieces as P
from factline.llm import units as U
from factline.sources import scratch

BYTE_LEVEL = "byte_bpe_50k.json"
#: Beyond these characters, all of old and settled classes, the tokenizer's own splitting of words is used.
NEWER = re.compile("[^\x00-ɏ]")


# --- compressed sparse rows --------------------------------------------------------------------


@dataclass
class Rows:
    """A sparse matrix of zeros and ones by rows: row i has ones in columns `columns[start[i]:start[i + 1]]`, ascending."""

    start: np.ndarray
    columns: np.ndarray
    width: int

    def transposed(self) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        n = np.bincount(self.columns, minlength=self.width)
        return Rows(np.concatenate([[0], np.cumsum(n)]), row[order], len(self.start) - 1)


def product(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the entries of a · b, by row and column.

    Row i of the product adds up the rows of b that row i of a names; all rows are done at once.
    """
    n = np.diff(b.start)[a.columns]
    row = np.repeat(np.repeat(np.arange(len(a.start) - 1), np.diff(a.start)), n)
    at = np.repeat(b.start[a.columns] - (np.cumsum(n) - n), n) + np.arange(len(row))
    key = row * b.width + b.columns[at]
    if len(key) and (key[1:] < key[:-1]).any():
        key = np.sort(key)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    value = np.diff(first, append=len(key))
    return key[first] // max(b.width, 1), key[first] % max(b.width, 1), value


def by_bytes(ends: np.ndarray, width: int) -> Rows:
    """Tokens by bytes, for tokens in a row that end at `ends`."""
    return Rows(np.concatenate([[0], ends]), np.arange(width), width)


def by_groups(group: np.ndarray, groups: int) -> Rows:
    """Tokens by groups."""
    return Rows(np.arange(len(group) + 1), group, groups)


# --- tokenizers --------------------------------------------------------------------------------


class ByteLevel:
    """Encodes texts by the byte-level vocabulary in the file at `path`; special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # The file writes every byte as one character: the printable ones as themselves, the rest in turn from 256 on.
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
        hidden = [c for c in range(256) if c not in shown]
        byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(hidden)}
        assert set(byte) == set(pre_tokenizers.ByteLevel.alphabet())
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        # The same vocabulary as ranks: a quarter of the time.
        self.quick = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids_of(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings in one array, number of ids of each)."""
        out = [self.tokenizer.encode(s, add_special_tokens=False).ids if NEWER.search(s) else self.quick.encode_ordinary(s) for s in strings]
        n = np.array([len(x) for x in out], np.int64)
        return np.fromiter(chain.from_iterable(out), np.int32, int(n.sum())), n


class Aligner:
    """Two tokenizers and the pairs of their ids that can end together."""

    def __init__(self, byte_level: str, model: str):
        import public_tokenizers

        self.a, self.b = ByteLevel(public_tokenizers.path(byte_level)), P.Pieces(public_tokenizers.path(model))
        (self.a_size, *self.a_bytes), (self.b_size, *self.b_bytes) = joined(self.a.bytes), joined(self.b.bytes)
        # A pair's number: twice the place of the longer token's byte where the shorter one starts, counted back,
        # and one more where B's is the piece of a byte, whose bytes another piece may have too.
        self.a_place, self.b_place = self.a_bytes[1], self.b_bytes[1] + len(self.a_bytes[0])
        self.is_byte = np.array([self.b.library.is_byte(i) for i in range(len(self.b.bytes))])
        self.numbers = 2 * (len(self.a_bytes[0]) + len(self.b_bytes[0]))
        a_id = {t: i for i, t in enumerate(self.a.bytes) if t}
        assert len(a_id) == sum(map(bool, self.a.bytes))
        both = [(i, j) for j, t in enumerate(self.b.bytes) for k in range(len(t)) if (i := a_id.get(t[k:])) is not None]
        by_text = {(t, bool(f)): j for j, (t, f) in enumerate(zip(self.b.bytes, self.is_byte)) if t}
        both += [(i, j) for t, i in a_id.items() for k in range(len(t)) for f in (False, True) if (j := by_text.get((t[k:], f))) is not None]
        #: The B id of each number that a pair has, else -1.
        self.b_of = np.full(self.numbers, -1)
        i, j = np.array(both).T
        self.b_of[self.number(i, j)] = j
        texts = [str(i) for i in range(max(len(self.a.bytes), len(self.b.bytes)))]
        #: Decimal ids with what follows them, as eight bytes.
        self.text = np.array([[f"{t}{sep}" for t in texts] for sep in ",|;"], "S8").view(np.uint64).reshape(3, -1)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of pairs of ids that end together."""
        m, n = self.a_size[a], self.b_size[b]
        return (2 * np.where(m >= n, self.a_place[a] + n - 1, self.b_place[b] + m - 1) + self.is_byte[b]).astype(np.int32)

    def encode(self, strings: list[str]) -> tuple[list[bool], Part]:
        """Which strings both tokenizers give back byte by byte, and these aligned."""
        raw = [s.encode() for s in strings]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        found = []
        for side, size, table in ((self.a, self.a_size, self.a_bytes), (self.b, self.b_size, self.b_bytes)):
            ids, n = side.ids_of(strings)
            ends, last = np.cumsum(size[ids]), np.concatenate([[0], np.cumsum(n)])
            found.append((ids, ends, last))
            at = np.concatenate([[0], ends])[last]
            if not np.array_equal(at, bounds) or not np.array_equal(bytes_of(ids, size, *table), np.frombuffer(b"".join(raw), np.uint8)):
                if len(strings) == 1:
                    return [False], self.aligned([])
                good = [self.encode([s])[0][0] for s in strings]
                return good, self.aligned([s for s, g in zip(strings, good) if g])
        return [True] * len(strings), Part(self, bounds, *found)

    def aligned(self, strings: list[str]) -> Part:
        if strings:
            return self.encode(strings)[1]
        none = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64))
        return Part(self, np.zeros(1, np.int64), none, none)


class Part:
    """Strings in a row, aligned. Arrays are over all of them; `cuts` say where each string's own lie."""

    def __init__(self, own: Aligner, bounds: np.ndarray, a: tuple, b: tuple):
        self.own, self.bounds = own, bounds
        (self.a_ids, self.a_ends, self.a_cuts), (self.b_ids, self.b_ends, self.b_cuts) = a, b
        width = int(bounds[-1])
        mark = np.zeros(width + 1, np.uint8)
        mark[self.a_ends] = 1
        mark[self.b_ends] += 2
        #: The group that each token is of, and for each group how many tokens of A and of B precede its end.
        a_last, b_last = mark[self.a_ends] == 3, mark[self.b_ends] == 3
        self.a_group, self.b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        self.group_a, self.group_b = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        self.group_cuts = np.searchsorted(self.a_ends[self.group_a - 1], bounds, side="right")
        self.group_cuts[0] = 0
        self.width = width

    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token of A, token of B, shared bytes) of all tokens that overlap."""
        return product(by_bytes(self.a_ends, self.width), by_bytes(self.b_ends, self.width).transposed())

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token of A, token of B, 1) of all tokens of one group."""
        groups = len(self.group_a)
        return product(by_groups(self.a_group, groups), by_groups(self.b_group, groups).transposed())

    def ending(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of the pairs of ids of those overlaps whose tokens end together."""
        here = self.a_ends[a] == self.b_ends[b]
        return self.own.number(self.a_ids[a[here]], self.b_ids[b[here]])

    def texts(self) -> list[bytes]:
        """Each string's groups as `a1,a2|b1;a3|b2,b3`, in decimal ids; every group closed by a semicolon."""
        text = self.own.text
        a_texts, b_texts = text[0][self.a_ids], text[0][self.b_ids]
        a_texts[self.group_a - 1] = text[1][self.a_ids[self.group_a - 1]]
        b_texts[self.group_b - 1] = text[2][self.b_ids[self.group_b - 1]]
        # A token of A follows the B tokens of earlier groups, one of B the A tokens of its own group too.
        in_turn = np.zeros(len(a_texts) + len(b_texts), np.uint64)
        in_turn[np.arange(len(a_texts)) + np.append(0, self.group_b)[self.a_group]] = a_texts
        in_turn[np.arange(len(b_texts)) + self.group_a[self.b_group]] = b_texts
        wide = in_turn.view(np.uint8)
        used = wide != 0
        ends = np.append(0, np.cumsum(used.reshape(-1, 8).sum(axis=1, dtype=np.int64)))[self.a_cuts + self.b_cuts].tolist()
        out = wide[used].tobytes()
        return [out[s:e] for s, e in zip(ends, ends[1:])]


@lru_cache(1)
def aligner(byte_level: str, model: str) -> Aligner:
    """One for each Python worker: reading two vocabularies costs more than a small task."""
    return Aligner(byte_level, model)


def parts(texts: list[str | None], own: Aligner) -> Iterator[tuple[list[int], list[int], Part]]:
    """(rows of strings that are aligned, rows of strings that aren't, part) for slices of the texts in turn."""
    for some in U.slices(texts):
        good, part = own.encode([s for _, s in some])
        yield [i for (i, _), g in zip(some, good) if g], [i for (i, _), g in zip(some, good) if not g], part


def joined(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, bytes, start) of tokens written in a row."""
    size = np.array([len(t) for t in tokens], np.int64)
    return size, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size


def bytes_of(ids: np.ndarray, size: np.ndarray, table: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The bytes of tokens in a row."""
    n = size[ids]
    total = np.cumsum(n)
    return table[np.repeat(start[ids] - (total - n), n) + np.arange(total[-1] if len(n) else 0)]


# --- over tables -------------------------------------------------------------------------------

ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, group_a array<int>, group_b array<int>"
OVERLAPS = ", overlap_a array<int>, overlap_b array<int>, overlap_bytes array<int>"
SHARED = ", shared_a array<int>, shared_b array<int>"


def aligned(docs: DataFrame, overlaps: bool = True, shared: bool = False, byte_level: str = BYTE_LEVEL, model: str = P.MODEL) -> DataFrame:
    """Every row's tokens and how they correspond.

    a_ids, b_ids: tokens of a space and the text, and a_ends, b_ends: the bytes that they end at.
    group_a, group_b: of every group, how many tokens of A and B lie before its end.
    overlap_*: numbers of tokens (from 0) that overlap, and the bytes they share.
    shared_*: all tokens of A and B of one group, which for texts with long groups are many.
    Null and empty texts, and those that either tokenizer doesn't give back, have empty arrays. Repeated
    rows and null ids come as they are; other columns are ignored.
    """
    schema = ALIGNED + (OVERLAPS if overlaps else "") + (SHARED if shared else "")
    width = schema.count("array")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_level, model)
        for doc_ids, texts in U.texts_of(batches):
            got: list[list | None] = [[] for _ in texts]
            base = np.zeros((len(texts), 3), np.int64)
            for rows, bad, part in parts(texts, own):
                over = part.overlaps() if overlaps else ()
                together = part.shared()[:2] if shared else ()
                for k, i in enumerate(rows):
                    (a0, a1), (b0, b1), (g0, g1) = (x[k : k + 2] for x in (part.a_cuts, part.b_cuts, part.group_cuts))
                    at = part.bounds[k]
                    # Tokens and bytes before this slice, of the row less those of the part.
                    sa, sb, sc = base[i] - (a0, b0, at)
                    row = [part.a_ids[a0:a1], part.b_ids[b0:b1], part.a_ends[a0:a1] + sc, part.b_ends[b0:b1] + sc, part.group_a[g0:g1] + sa, part.group_b[g0:g1] + sb]
                    for pairs in (over, together):
                        if pairs:
                            lo, hi = np.searchsorted(pairs[0], (a0, a1))
                            row += [pairs[0][lo:hi] + sa, pairs[1][lo:hi] + sb, *(x[lo:hi] for x in pairs[2:])]
                    if got[i] is not None:
                        got[i].append(row)
                    base[i] += (a1 - a0, b1 - b0, part.bounds[k + 1] - at)
                for i in bad:
                    got[i] = None
            lists = []
            for c in range(width):
                values = [[x[c] for x in g or ()] for g in got]
                flat = [x for v in values for x in v]
                n = [sum(map(len, v)) for v in values]
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *flat]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([doc_ids, *lists], names=[c.split()[0] for c in schema.split(", ")])

    return _texts(docs).mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, links array<int>"


def links_of(docs: DataFrame, byte_level: str = BYTE_LEVEL, model: str = P.MODEL) -> DataFrame:
    """Numbers and digest of every row's groups, and `links`: the pair of each overlap whose tokens end together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_level, model)
        for doc_ids, texts in U.texts_of(batches):
            n, links = np.zeros((len(texts), 4), np.int64), [[] for _ in texts]
            sha, wrong = [sha256() if t else None for t in texts], set()
            begun: set[int] = set()
            for good, bad, part in parts(texts, own):
                wrong.update(bad)
                a, b, _ = part.overlaps()
                pair = part.ending(a, b)
                over = np.searchsorted(a, part.a_cuts)
                for k, (i, text) in enumerate(zip(good, part.texts())):
                    # The last group's semicolon goes, so it is written before a row's next slice.
                    sha[i].update((b";" if i in begun else b"") + text[:-1])
                    begun.add(i)
                    g0, g1 = part.group_cuts[k : k + 2]
                    links[i].append(pair[g0:g1])
                    n[i] += (part.a_cuts[k + 1] - part.a_cuts[k], part.b_cuts[k + 1] - part.b_cuts[k], g1 - g0, over[k + 1] - over[k])
            for i in wrong:
                n[i], links[i], sha[i] = 0, [], None
            flat = [x for v in links for x in v]
            at = np.concatenate([[0], np.cumsum([sum(map(len, v)) for v in links])]).astype(np.int32)
            out = [n[:, 0], n[:, 1], n[:, 2], np.diff(at).astype(np.int64), n[:, 3]]
            hexes = pa.array([x.hexdigest() if x else "" for x in sha], pa.string())
            pairs = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
            yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, out), hexes, pairs], names=[c.split()[0] for c in COUNTED.split(", ")])
        # The worker goes on to other tasks; what units encode to is learned again sooner than it is needed.
        own.b.memory.clear()

    return _texts(docs).mapInArrow(run, COUNTED)


def few(links: pa.ListArray, numbered: bool = False) -> Iterator:
    """The lists in turn, as many at once as hold about a million values, with the number of the first."""
    at = links.offsets.to_numpy()
    first = 0
    while first < len(links):
        last = max(int(np.searchsorted(at, at[first] + 1_000_000, side="right")) - 1, first + 1)
        part = links.slice(first, last - first)
        yield (first, part) if numbered else part
        first = last


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n) of all `links`: every task counts its own pairs, then counts add up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for links in few(batch.column(0)):
                more = np.bincount(links.flatten().to_numpy(), minlength=len(total))
                more[: len(total)] += total
                total = more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["pair", "n"])

    return links.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, byte_level: str = BYTE_LEVEL, model: str = P.MODEL) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_overlaps, groups_sha256 of every row.

    A link is an overlap whose tokens end together; its count is how many links of all rows have its
    ids, and it is a best one where no other A id has a higher count with its B id. The counts that
    come to the driver and go to every task are one number for each pair of ids that can end
    together, a fixed number for two vocabularies. Rows without tokens (null, empty, or not given back)
    have zeros and an empty digest; repeated rows count as often as they come. No rows: no rows.
    """
    rows = scratch.written(links_of(docs, byte_level, model), "token-links")
    own = aligner(byte_level, model)
    count = np.zeros(own.numbers, np.int64)
    for r in pair_counts(rows).toLocalIterator():
        count[r.pair] = r.n
    used = np.flatnonzero(own.b_of >= 0)
    most = np.zeros(len(own.b.bytes), np.int64)
    np.maximum.at(most, own.b_of[used], count[used])
    counts = docs.sparkSession.sparkContext.broadcast((count, count == most[own.b_of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = counts.value
        for batch in batches:
            kept = batch.drop_columns(["links"])
            for first, links in few(batch.column("links"), True):
                at, pair = links.offsets.to_numpy() - links.offsets[0].as_py(), links.flatten().to_numpy()
                sums = [np.concatenate([[0], np.cumsum(x[pair], dtype=np.int64)]) for x in (best, count)]
                more = [pa.array(s[at[1:]] - s[at[:-1]]) for s in sums]
                yield pa.RecordBatch.from_arrays([*kept.slice(first, len(links)).columns, *more], names=[*kept.schema.names, "n_best", "count_sum"])

    return rows.mapInArrow(run, COUNTED.removesuffix(", links array<int>") + ", n_best long, count_sum long")
