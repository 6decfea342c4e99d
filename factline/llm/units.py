"""Texts cut where no tokenizer joins, and a bounded memory of what the parts encode to.

A text is read with one space before it. Between a character that is no white space and a space both
kinds of tokenizer here start anew: byte-level ones split words there before they merge, and pieces
hold their mark of a space at the front only. So the ids of a text are those of its units in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
CUT = re.compile(rf"(?<=[^\s{MARK}])(?= )")
LONG_CUT = re.compile(rf"(?<=[^\s{MARK}]) (?=\S)")
#: A space between two other white spaces; there cutting at every space would part what is one token.
ODD = re.compile(r"[^\S ] [^\S ]")
#: Characters handled at once, and bounds of a memory; they change no result.
SLICE = 500_000
UNITS, CHARACTERS = 300_000, 8_000_000


def texts_of(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(ids, texts) of a few rows (doc_id, text) at a time, about `most` bytes of text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(size):
            before = size[first - 1] if first else 0
            last = min(int(np.searchsorted(size, before + most)) + 1, len(size))
            yield batch.column("doc_id").slice(first, last - first), batch.column("text").slice(first, last - first).to_pylist()
            first = last


def slices(texts: list[str | None], most: int = SLICE) -> Iterator[list[tuple[int, str]]]:
    """Lists of (row, slice) of about `most` characters. Slices of a row in turn make up a space and its text.

    Every slice starts with a space and ends where tokens end; null and empty texts have none.
    """
    part: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        s, start = " " + text, 0
        while start < len(s):
            cut = LONG_CUT.search(s, start + most) if len(s) - start > most else None
            end = cut.start() if cut else len(s)
            part.append((i, s[start:end]))
            size += end - start
            start = end
            if size >= most:
                yield part
                part, size = [], 0
    if part:
        yield part


def units(s: str) -> list[str]:
    """The units of a slice, each without the space that it starts with."""
    if "  " in s or s[-1] == " " or MARK in s or ODD.search(s):
        return [u[1:] for u in CUT.split(s)]
    return s.split(" ")[1:]


class Memory:
    """Ids of units, remembered; `encode` gives (units in any order, their ids in a row, counts) of new ones."""

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.count, self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def ids_of(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices in one array, number of ids of each slice)."""
        if len(self.known) > UNITS or self.size > CHARACTERS:
            self.clear()
        keys: list[str] = []
        ends = np.zeros(len(strings) + 1, np.int64)
        for k, s in enumerate(strings):
            keys += units(s)
            ends[k + 1] = len(keys)
        new = list(set(keys).difference(self.known))
        if new:
            new, ids, counts = self.encode(new)
            self.known.update(zip(new, range(len(self.count), len(self.count) + len(new))))
            self.ids, self.count = np.append(self.ids, ids), np.append(self.count, counts)
            self.size += sum(map(len, new))
        index = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        n = self.count[index].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        first = np.cumsum(self.count, dtype=np.int64) - self.count
        at = np.repeat(first[index] - total[:-1], n) + np.arange(total[-1])
        return self.ids[at], np.diff(total[ends])
