"""Token counts of whole texts under a byte-level BPE vocabulary, by the whole-token shortcut.

Offline, each string of the vocabulary is put through the merges alone; those that come out as one token are the whole tokens. A
pre-token among them counts one without any merging. Only the rest are merged, once per distinct pre-token while a worker
remembers it. The library counts texts that hold a special string, and stretches between two spaces with characters on whose kind
Unicode versions differ (see pretokens).

Nulls and empty texts count 0 tokens and 0 bytes. Repeated rows are counted each; a null id is kept. An empty table gives an empty
result. Columns other than the two named are not read. One scan, no shuffle; a worker's memory is bounded by MOST_WORDS remembered pre-tokens.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as pt
from .common import map_rows


def whole_tokens(path: str) -> frozenset[str]:
    """The proven pre-tokens: strings of the vocabulary that the merges turn into exactly one token."""
    model, letters = pt.load(path).model, {v: k for k, v in pt.byte_letters().items()}
    found = []
    for piece in pt.load(path).get_vocab(with_added_tokens=False):
        if len(model.tokenize(piece)) == 1 and all(c in letters for c in piece):
            try:
                found.append(bytes(letters[c] for c in piece).decode())
            except UnicodeDecodeError:
                continue
    return frozenset(found)


class Counts(dict):
    """Tokens by pre-token: 1 for the whole tokens, merged on first sight for the others."""

    def __init__(self, path: str):
        super().__init__(dict.fromkeys(whole_tokens(path), 1))
        self.model, self.least = pt.load(path).model, len(self)

    def __missing__(self, word: str) -> int:
        n = len(self.model.tokenize(pt.byte_level(word)))
        if len(self) - self.least >= pt.MOST_WORDS:
            for key in [*self][self.least :]:
                del self[key]
        if len(word) < 1000:
            self[word] = n
        return n


class Chunks(dict):
    """Tokens by chunk, where a chunk is what stands between two single spaces and is counted with the space before it."""

    def __init__(self, path: str):
        super().__init__()
        self.counts = Counts(path)

    def __missing__(self, chunk: str) -> int:
        n = sum(map(self.counts.__getitem__, pt.BYTE_PATTERN.findall(f" {chunk}")))
        if len(self) >= pt.MOST_WORDS:
            self.clear()
        if len(chunk) < 100:
            self[chunk] = n
        return n


class Stretches(dict):
    """Tokens of what stands between two cuts, of any characters."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.counts = path, chunks_for(path).counts

    def __missing__(self, stretch: str) -> int:
        if pt.KNOWN.fullmatch(stretch):
            n = sum(self.counts[m[0]] for m in pt.BYTE_PATTERN.finditer(stretch))
        elif pt.steady().fullmatch(stretch):
            n = sum(self.counts[m[0]] for m in pt.GENERAL_PATTERN.finditer(stretch))
        else:
            n = len(pt.load(self.path).encode(stretch, add_special_tokens=False).ids)
        if len(self) >= pt.MOST_WORDS:
            self.clear()
        if len(stretch) < 100:
            self[stretch] = n
        return n


@lru_cache(maxsize=2)
def stretches_for(path: str) -> Stretches:
    return Stretches(path)


@lru_cache(maxsize=2)
def chunks_for(path: str) -> Chunks:
    return Chunks(path)


def count(text: str, path: str) -> int:
    if pt.has_special(text, pt.special_strings(path)):
        return len(pt.load(path).encode(text, add_special_tokens=False).ids)
    if not pt.KNOWN.fullmatch(text):
        return sum(map(stretches_for(path).__getitem__, pt.CUT.split(text)))
    chunks = chunks_for(path)
    counts = chunks.counts
    if not pt.UNEVEN.search(text):  # each space begins a pre-token
        first, *rest = text.split(" ")
        return sum(map(counts.__getitem__, pt.BYTE_PATTERN.findall(first))) + sum(map(chunks.__getitem__, rest))
    if len(text) > pt.LONG_TEXT:
        return sum(counts[m[0]] for m in pt.BYTE_PATTERN.finditer(text))
    return sum(map(counts.__getitem__, pt.BYTE_PATTERN.findall(text)))


def token_counts(documents: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, n_bytes, n_tokens and whether n_tokens is over the limit."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(ids, texts):
        n = [count(t, path) for t in texts]
        return ids, [len(t.encode()) for t in texts], n, [x > limit for x in n]

    return map_rows(texts, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", work)
