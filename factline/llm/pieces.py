"""SentencePiece ids of texts with the source bytes of every piece, and texts of ids.

A text is normalised by the model's compiled character map: at each place the longest prefix that the
map holds is replaced, any other character stands for itself, and every normalised byte keeps the
place in the source of the prefix that it comes from. Pieces are cut from the normalised text, so
their ends in it, looked up in that alignment, are byte spans of the original.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import units as U

MODEL = "piece_bpe_32k.model"
UNITS_AT_ONCE = 2_000


# --- the model's file --------------------------------------------------------------------------


def fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, raw bytes) of the fields of an encoded message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    at = 0
    while at < len(data):
        start = at
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value, data[start:at]


class CharacterMap:
    """A compiled character map: a double array over UTF-8 bytes, and the replacements it points to."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.cells = np.frombuffer(data, "<u4", size // 4, 4).tolist() if data else []
        self.texts = data[4 + size :]

    @staticmethod
    def child(cell: int) -> int:
        """How far a cell's children lie from it; bit 9 says that the distance is in 256s."""
        return (cell >> 10) << (8 if cell & 512 else 0)

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that stands in `data` at `start`."""
        if not self.cells:
            return None
        found, cells = None, self.cells
        node = self.child(cells[0])
        for i in range(start, len(data)):
            node ^= data[i]
            # The label has 8 bits; bit 31 marks cells that hold values instead.
            if node >= len(cells) or cells[node] & 0x800000FF != data[i]:
                break
            cell = cells[node]
            node ^= self.child(cell)
            if cell & 256:
                at = cells[node] & 0x7FFFFFFF
                found = i + 1 - start, self.texts[at : self.texts.index(b"\0", at)]
        return found


class Normaliser:
    """The model's normalisation, apart from the space before a text and the mark for spaces."""

    def __init__(self, charsmap: bytes, squeeze: bool):
        self.map, self.squeeze = CharacterMap(charsmap), squeeze
        self.identity = not charsmap and not squeeze

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, alignment): the source place of every normalised byte, and that of the end."""
        if self.identity:
            return data, np.append(starts(np.frombuffer(data, np.uint8)), len(data))
        out, source = bytearray(), []
        at, after_space = 0, self.squeeze
        while at < len(data):
            n, text = self.map.longest(data, at) or (0, b"")
            if not n:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                text = data[at : at + n]
            if after_space:
                text = text.lstrip(b" ")
            if text:
                out += text
                source += [at] * len(text)
                after_space = self.squeeze and text.endswith(b" ")
            at += n
        end = at
        if self.squeeze:
            kept = len(out.rstrip(b" "))
            end = source[kept] if kept < len(out) else end
            del out[kept:], source[kept:]
        return bytes(out), np.array([*source, end], np.int64)


def starts(raw: np.ndarray) -> np.ndarray:
    """For every byte of UTF-8 the place where its character starts."""
    return np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, np.arange(len(raw)), 0)) if len(raw) else np.zeros(0, np.int64)


class Pieces:
    """Encodes texts by the model in the file at `path`: merges of pieces, bytes for unknown characters.

    Models that add no space before texts, or have no pieces for bytes, are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            data = f.read()
        self.library = SentencePieceProcessor(model_proto=data)
        spec = {n: v for number, value, _ in fields(data) if number == 3 for n, v, _ in fields(value)}
        if not (spec.get(3, 1) and spec.get(5, 1)):
            raise ValueError("the model must put a space before texts and mark spaces")
        self.normalise = Normaliser(spec.get(2, b""), bool(spec.get(4, 1)))
        # Texts come to the library normalised, so its own model has the same pieces and no map.
        plain = b"".join(raw for number, _, raw in fields(data) if number != 3)
        self.plain = SentencePieceProcessor(model_proto=plain + b"\x1a\x06\x18\x01\x20\x00\x28\x01")
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) for i in range(size)]
        is_byte = [self.library.is_byte(i) for i in range(size)]
        if sum(is_byte) != 256:
            raise ValueError("the model must have pieces for all bytes")
        if any(U.MARK in p.lstrip(U.MARK) for p, s in zip(names, special) if not s):
            raise ValueError("a piece joins words")
        #: The bytes that a piece stands for, spaces as spaces.
        self.bytes = [b"" if s else bytes([int(p[3:5], 16)]) if b else p.replace(U.MARK, " ").encode() for p, s, b in zip(names, special, is_byte)]
        #: How long it is in the normalised text, where a space is a mark of three bytes.
        self.size = np.array([0 if s else 1 if b else len(p.encode()) for p, s, b in zip(names, special, is_byte)], np.int64)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.space = self.library.piece_to_id(U.MARK)
        self.front = np.array([not s and p.startswith(U.MARK) for p, s in zip(names, special)])
        self.memory = U.Memory(self._encode)

    def _encode(self, keys: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Units without a space inside are encoded together: where a piece starts with the mark, one starts."""
        alone = {k for k in keys if not k or " " in k or U.MARK in k}
        joined, counts, ids = [k for k in keys if k not in alone], [], []
        for s in range(0, len(joined), UNITS_AT_ONCE):
            some = joined[s : s + UNITS_AT_ONCE]
            got = np.array(self.plain.encode(" ".join(some)), np.int32)
            front = np.flatnonzero(self.front[got])
            assert len(front) == len(some)
            ids.append(got)
            counts.append(np.diff(front, append=len(got)))
        rest = sorted(alone)
        # The library encodes the empty text as nothing; here it is a unit that is its space alone.
        each = [x or [self.space] for x in self.plain.encode(rest, num_threads=1)]
        ids += [np.array(x, np.int32) for x in each]
        counts.append(np.array([len(x) for x in each], np.int64))
        return joined + rest, np.concatenate(ids), np.concatenate(counts).astype(np.int32)

    def ids_of(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each) of normalised slices that start with their space."""
        return self.memory.ids_of(strings)

    def spans(self, ids: np.ndarray, raw: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of each piece: `raw` are the bytes of all slices, `source` their places and one for the end."""
        wide = np.append(np.repeat(source[:-1], np.where(raw == 32, 3, 1)), source[-1])
        end = np.cumsum(self.size[ids])
        return wide[end - self.size[ids]], wide[end]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids, begins, ends, bounds) for parts of the texts; part k of ids is `bounds[k:k + 2]`'s, of text `rows[k]`.

        A row's parts come in order. Spans are bytes of the row's own text; the space before it has none.
        """
        before = np.zeros(len(texts), np.int64)
        if self.normalise.identity:
            for part in U.slices(texts):
                rows = np.array([i for i, _ in part])
                ids, n = self.ids_of([s for _, s in part])
                raw = np.frombuffer("".join(s for _, s in part).encode(), np.uint8)
                size = np.array([len(s.encode()) for _, s in part])
                bounds = np.concatenate([[0], np.cumsum(n)])
                begin, end = self.spans(ids, raw, np.append(starts(raw), len(raw)))
                # Slices of one text follow each other, so its offset is known when a part starts.
                shift = np.zeros(len(part), np.int64)
                at = 0
                for k, i in enumerate(rows):
                    shift[k] = before[i] - 1 - at
                    before[i] += size[k]
                    at += size[k]
                shift = np.repeat(shift, n)
                yield rows.tolist(), ids, np.maximum(begin + shift, 0), np.maximum(end + shift, 0), bounds
            return
        for i, text in enumerate(texts):
            data, source = self.normalise((text or "").encode())
            if data:
                ids, n = self.ids_of([" " + data.decode()])
                raw = np.frombuffer(b" " + data, np.uint8)
                begin, end = self.spans(ids, raw, np.concatenate([source[:1], source]))
                yield [i], ids, begin, end, np.array([0, len(ids)])


@lru_cache(1)
def pieces(name: str) -> Pieces:
    """One encoder a Python worker: reading the model costs more than a small task."""
    import public_tokenizers

    return Pieces(public_tokenizers.path(name))


def encoded_batch(texts: list[str | None], own: Pieces) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, begins, ends) of each text, begin and end ids included, as 32-bit integers."""
    got: list[list[tuple]] = [[] for _ in texts]
    for rows, ids, begin, end, bounds in own.encode(texts):
        for k, i in enumerate(rows):
            a, b = bounds[k], bounds[k + 1]
            got[i].append((ids[a:b], begin[a:b], end[a:b]))
    out = []
    for text, parts in zip(texts, got):
        n = len((text or "").encode())
        first, last = ([own.bos], [0], [0]), ([own.eos], [n], [n])
        out.append(tuple(np.concatenate(x).astype(np.int32) for x in zip(first, *parts, last)))
    return out


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, begins, ends) of every row: ids with begin and end ids, and each id's byte span in the text.

    Null texts are empty, so they have the begin and end ids alone; repeated rows and null ids are kept as
    they come, other columns are ignored. Of a character that is written as bytes the last byte's piece
    has the whole span and the others an empty one. The first piece's leading space is in no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for doc_ids, texts in U.texts_of(batches):
            out = encoded_batch(texts, own)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in out])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in out]))) for k in range(3)]
            yield pa.RecordBatch.from_arrays([doc_ids, *lists], names=["doc_id", "ids", "begins", "ends"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """`tokens` (doc_id, ids and any others) with `text`: what the ids decode to; null ids give a null text."""

    @F.pandas_udf("string")
    def text_of(ids):
        own = pieces(model).library
        return ids.map(lambda x: None if x is None else own.decode(x.tolist()))

    return tokens.withColumn("text", text_of("ids"))


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids, of the text they decode to, and of the spans (begins, then ends)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for doc_ids, texts in U.texts_of(batches):
            out = encoded_batch(texts, own)
            back = own.library.decode([x[0].tolist() for x in out], num_threads=1)
            hexes = [[sha256(x[0].astype("<u4").tobytes()).hexdigest() for x in out], [sha256(t.encode()).hexdigest() for t in back]]
            hexes.append([sha256(x[1].astype("<u4").tobytes() + x[2].astype("<u4").tobytes()).hexdigest() for x in out])
            n = pa.array([len(x[0]) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([doc_ids, n, *map(pa.array, hexes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
