"""Packing of documents into training sequences by best-fit decreasing.

A document's ids come from a word-level BPE vocabulary, with one closing id. A task takes its documents in blocks of about
BLOCK_IDS ids. In each block, overlong documents are first cut into full windows; what is left of each document goes, longest
first, to the tightest open window that has room, which a segment tree over remaining capacities finds. As pieces may be cut
freely, the windows that stay ragged are then settled: the emptiest give their pieces away to fill the gaps of the others, and what
remains at the end of the block becomes sequences whose lengths are powers of two, which need no padding.

Nulls and empty texts are documents of the closing id alone. Repeated rows are packed each. There is no shuffle: a task packs what
it scans, and a repeated task gives the same rows again, as sequence ids derive from the number of its partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as pt
from .common import columns_of, remembered, slices, tidied

#: Ids that a task holds at once (two bytes each); several thousand documents, so that best fit finds partners.
BLOCK_IDS = 8_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences a task can number.
PER_TASK = 1 << 40
Piece = tuple[int, int, int]  # index of the document in the block, start, length


class WordIds(dict):
    """Ids by lower-case word between white space, as little-endian bytes of two; the vocabulary is smaller than 65,536."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = pt.load(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than two bytes")

    def __missing__(self, word: str) -> bytes:
        if not pt.KNOWN.fullmatch(word):
            tokens = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            tokens = [t.id for part in pt.WORD_PATTERN.findall(word) for t in self.tokenizer.model.tokenize(pt.byte_level(part))]
        ids = np.array(tokens, dtype="<u2").tobytes()
        if len(self) >= pt.MOST_WORDS:
            self.clear()
        if len(word) < 100:
            self[word] = ids
        return ids


@remembered(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode(text: str, path: str) -> bytes:
    """The library's ids of a text without special tokens, two bytes each."""
    if pt.has_special(text.lower(), tuple(s.lower() for s in pt.special_strings(path))):
        ids = pt.load(path).encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u2").tobytes()
    if not pt.KNOWN.fullmatch(text):  # the library sees words with other characters as they are
        words = [w.lower() if pt.KNOWN.fullmatch(w) else w for w in re.split("[ \\t\\n\\r]+", text) if w]
        return b"".join(map(word_ids(path).__getitem__, words))
    return b"".join(map(word_ids(path).__getitem__, text.lower().split()))


class Capacities:
    """Open windows by remaining capacity, with a segment tree of how many windows lie under each node."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.tree = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(self.base)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.base + capacity
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest window with room for least, and its capacity."""
        node, tree = self.base + least, self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.base
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[Piece]]:
    """Windows of pieces; documents longer than a window give full windows first."""
    packed: list[list[Piece]] = []
    rest: list[Piece] = []
    for i, n in enumerate(lengths):
        full = n // window
        packed += [[(i, k * window, window)] for k in range(full)]
        if n % window:
            rest.append((i, full * window, n % window))
    rest.sort(key=lambda p: (-p[2], p[0]))
    open_windows = Capacities(window)
    for piece in rest:
        found = open_windows.take(piece[2])
        if found is None:
            found = len(packed), window
            packed.append([])
        packed[found[0]].append(piece)
        if found[1] > piece[2]:
            open_windows.put(found[1] - piece[2], found[0])
    return packed


def cut_front(pieces: list[Piece], n: int) -> list[Piece]:
    """Takes pieces of n ids in all from the end of the list, cutting the last one taken."""
    taken = []
    while n:
        i, start, length = pieces.pop()
        if length > n:
            pieces.append((i, start + n, length - n))
            length = n
        taken.append((i, start, length))
        n -= length
    return taken


def settle(packed: list[list[Piece]], window: int) -> list[list[Piece]]:
    """No padding is left: gaps are filled from the emptiest windows, and the last remainder goes to powers of two."""
    fill = [sum(p[2] for p in w) for w in packed]
    ragged = sorted((k for k, n in enumerate(fill) if n & (n - 1) and n < window), key=lambda k: (-fill[k], k))
    done = [w for k, w in enumerate(packed) if k not in set(ragged)]
    low, high = 0, len(ragged) - 1
    while low < high:
        target, donor = ragged[low], ragged[high]
        give = min(window - fill[target], fill[donor])
        packed[target] += cut_front(packed[donor], give)
        fill[target] += give
        fill[donor] -= give
        if fill[target] == window:
            done.append(packed[target])
            low += 1
        if not fill[donor]:
            high -= 1
    if low == high:
        pieces, n = packed[ragged[low]], fill[ragged[low]]
        while n:
            part = 1 << (n.bit_length() - 1)
            done.append(cut_front(pieces, part))
            n -= part
    return done


def pack(lengths: list[int], window: int) -> list[list[Piece]]:
    return settle(best_fit_decreasing(lengths, window), window)


def packed_rows(ids: list, texts: list[bytes], first: int, window: int) -> list[tuple]:
    """Rows of SCHEMA for a block of documents given as bytes of their ids; sequences are numbered from first."""
    rows = []
    for k, pieces in enumerate(pack([len(t) // 2 for t in texts], window)):
        offset = 0
        for i, start, length in pieces:
            part = np.frombuffer(texts[i], dtype="<u2", offset=2 * start, count=length).astype("<u4")
            rows.append((ids[i], start, length, zlib.crc32(part), len(texts[i]) // 2, first + k, offset))
            offset += length
    return rows


def pack_documents(documents: DataFrame, path: str, window: int = 2048, closing_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence, with a checksum of its ids."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    closing = np.array([closing_id], dtype="<u2").tobytes()
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * PER_TASK
        ids, held, size = [], [], 0

        def flush():
            nonlocal first, ids, held, size
            rows = packed_rows(ids, held, first, window)
            first += len({r[5] for r in rows})
            ids, held, size = [], [], 0
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows[at : at + 50_000], strict=True)], names=names)

        for batch in slices(batches):
            for i, text in zip(*columns_of(batch), strict=True):
                ids.append(i)
                held.append(encode(text, path) + closing)
                size += len(held[-1]) // 2
                if size >= BLOCK_IDS:
                    yield from flush()
        if ids:
            yield from flush()

    return texts.mapInArrow(tidied(run), SCHEMA)
