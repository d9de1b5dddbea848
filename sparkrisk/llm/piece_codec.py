"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is put into the form that the model's identity normaliser gives (one space in front, spaces as U+2581) and cut where a run
of U+2581 begins; no piece of the vocabulary crosses such a cut, which is checked on loading. The distinct words that a worker has
not seen yet lie in one flat array of symbols, cut further into segments between characters that stand side by side in no piece, as
no merge crosses these. In each round, every segment's best rank is found by a segmented minimum, and the pairs of that rank are
merged at once, from the left, as far as this equals merging one after another: none that overlaps the one before, and none behind
one whose merge makes a pair that is no worse. Segments without a pair leave, and the array is compacted until none is left. Segments
of more than LONG_SEGMENT characters, each of which stands beside its neighbours in some piece, go through a heap instead, with the
same result, as rounds over them could take quadratic time. Characters without a piece fall back to bytes.

Decoding joins the pieces' bytes. Nulls count as empty: begin and end ids only, and an empty decoded text. Repeated rows are coded
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Characters of remembered words; then a worker's memory starts anew.
MOST_LETTERS = 4_000_000
#: Characters of a segment that still goes through the rounds.
LONG_SEGMENT = 4096
NONE = np.iinfo(np.int64).max
codecs.register_error("piece_byte", lambda e: ("�", e.start + 1))


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in plain):
            raise ValueError("a piece crosses a word's begin; this codec cuts texts there")
        self.by_byte = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.surface = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else names[i].encode() for i in range(n)]
        for b, i in self.by_byte.items():
            self.surface[i] = bytes([b])
        ids = {names[i]: i for i in plain}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        # a symbol is a piece, or n plus the code point of a character that is no piece
        self.n = n
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        for name, i in ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        left, right, merged = [], [], []
        for name, i in ids.items():
            for k in range(1, len(name)):
                a, b = name[:k], name[k:]
                x = ids.get(a, n + ord(a) if len(a) == 1 else None)
                y = ids.get(b, n + ord(b) if len(b) == 1 else None)
                if x is not None and y is not None:
                    left.append(x), right.append(y), merged.append(i)
        key = (np.array(left, dtype=np.int64) << 21) | np.array(right, dtype=np.int64)
        at = np.argsort(key)
        self.key, self.merged = key[at], np.array(merged, dtype=np.int64)[at]
        self.rank = np.array([order[sp.get_score(i)] for i in merged], dtype=np.int64)[at]
        self.neighbours = np.unique([ord(a) << 21 | ord(b) for name in ids for a, b in zip(name, name[1:], strict=False)])
        odd = "A \u00e9\u0301\ufb01\u00a0\u3000 "  # what other normalisers would change
        if sp.decode(sp.encode(odd)) != odd:
            raise ValueError("the vocabulary's normaliser changes texts; this codec takes them as they are")
        self.words: dict[str, bytes] = {}  # ids by word without its first U+2581
        self.letters = 0

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they do not merge) and place in the table of each pair of symbols."""
        key = (left << 21) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE), at

    def rounds(self, words: list[str]) -> list[np.ndarray]:
        """Final symbols of each word."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        # a segment ends with its word, and between two characters that no piece has side by side
        apart = ~np.isin(code[:-1] << 21 | code[1:], self.neighbours)
        apart[ends[:-1] - 1] = True
        segment = np.r_[0, np.cumsum(apart)]
        symbols, at = self.symbol[code], np.arange(len(code))
        done_symbols, done_at = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        sizes = np.bincount(segment)
        for k in np.flatnonzero(sizes > LONG_SEGMENT):
            here = np.flatnonzero(segment == k)
            left = self.one_by_one(symbols[here])
            done_symbols.append(left[left >= 0]), done_at.append(here[left >= 0])
        short = sizes[segment] <= LONG_SEGMENT
        symbols, segment, at = symbols[short], segment[short], at[short]
        while len(symbols):
            rank, place = self.pairs(symbols, np.r_[symbols[1:], 0])
            begins = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            size = np.diff(np.r_[begins, len(symbols)])
            ends_at = begins + size - 1
            rank[ends_at] = NONE  # a segment's last symbol has no partner
            best = np.repeat(np.minimum.reduceat(rank, begins), size)
            done = best == NONE
            hits = np.flatnonzero((rank == best) & ~done)
            if len(hits):
                hits = self.together(hits, symbols, segment, best, place)
            symbols[hits] = self.merged[place[hits]]
            done_symbols.append(symbols[done]), done_at.append(at[done])
            keep = ~done
            keep[hits + 1] = False
            symbols, segment, at = symbols[keep], segment[keep], at[keep]
        at = np.concatenate(done_at)
        order = np.argsort(at)
        symbols, at = np.concatenate(done_symbols)[order], at[order]
        return np.split(symbols, np.searchsorted(at, ends[:-1]))

    def together(self, hits: np.ndarray, symbols: np.ndarray, segment: np.ndarray, best: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of the pairs of their segments' best rank those that merge in this round as they would one after another, from the left:
        none that overlaps the one before, and none behind one whose merge makes a pair that is no worse."""
        run = np.r_[True, np.diff(hits) != 1]
        first = np.flatnonzero(run)
        hits = hits[(np.arange(len(hits)) - np.repeat(first, np.diff(np.r_[first, len(hits)]))) % 2 == 0]
        new, of, n = self.merged[place[hits]], segment[hits], len(symbols)
        before, behind = np.maximum(hits - 1, 0), np.minimum(hits + 2, n - 1)
        touching = np.r_[False, hits[1:] - hits[:-1] == 2]
        left = np.where(touching, np.r_[0, new[:-1]], symbols[before])
        loud = (self.pairs(left, new)[0] <= best[hits]) & (hits > 0) & (segment[before] == of)
        loud |= (self.pairs(new, symbols[behind])[0] <= best[hits]) & (hits + 2 < n) & (segment[behind] == of)
        begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        earlier = np.cumsum(loud) - loud  # loud ones before each
        return hits[earlier == np.repeat(earlier[begins], np.diff(np.r_[begins, len(hits)]))]

    def one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges for one very long segment, with a heap over its pairs; -1 where a symbol went into the one before."""
        rank, _ = self.pairs(symbols[:-1], symbols[1:])
        heap = [(int(rank[i]), int(i), int(symbols[i]), int(symbols[i + 1])) for i in np.flatnonzero(rank != NONE)]
        heapq.heapify(heap)
        sym, n = symbols.tolist(), len(symbols)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def push(i: int, j: int) -> None:
            key = (sym[i] << 21) | sym[j]
            k = int(np.searchsorted(self.key, key))
            if k < len(self.key) and self.key[k] == key:
                heapq.heappush(heap, (int(self.rank[k]), i, sym[i], sym[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i] = int(self.merged[np.searchsorted(self.key, (a << 21) | b)])
            sym[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array(sym, dtype=np.int64)

    def ids_of(self, symbols: np.ndarray) -> bytes:
        if not (symbols >= self.n).any():
            return symbols.astype("<u4").tobytes()
        ids: list[int] = []
        for s in symbols.tolist():
            ids += [s] if s < self.n else [self.by_byte[b] for b in chr(s - self.n).encode()]
        return np.array(ids, dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        if self.letters > MOST_LETTERS:
            self.words.clear()
            self.letters = 0
        new = [w for w in words if w not in self.words]
        self.letters += sum(map(len, new))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.words.update(zip(part, map(self.ids_of, self.rounds([SPACE + w for w in part])), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end ids, as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        self.learn(set().union(*cut))
        begin, end = (np.array([x], dtype="<u4").tobytes() for x in (self.bos, self.eos))
        return [begin + b"".join(map(self.words.__getitem__, ws)) + end for ws in cut]

    def cut(self, text: str) -> list[str]:
        """The words of a text, each without the U+2581 that it begins with."""
        if not text:
            return []
        if text[0] == " " or "  " in text or SPACE in text:
            return [w[1:] for w in WORDS.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def decode(self, ids: bytes) -> str:
        """The text of ids given as bytes: without the space put in front, and with U+FFFD for each byte that is no UTF-8."""
        joined = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return joined.removeprefix(SPACE.encode()).decode("utf-8", "piece_byte").replace(SPACE, " ")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def round_trips(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the number of ids, a digest of them and a digest of what they decode to."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(doc_ids, texts):
        own = codec(path)
        ids = own.encode_batch(texts)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return doc_ids, [len(x) // 4 for x in ids], [*map(digest, ids)], [digest(own.decode(x).encode()) for x in ids]

    return map_rows(texts, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
