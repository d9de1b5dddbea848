"""Exact dedup by a log-structured merge index over digests.

Texts are equal when they are identical after each run of white space becomes one space. Each scanning task feeds (digest, id, row)
into an index of its own: digests that a run already holds, as the run's filter and a binary search tell, change that run's entry; the
others fill a memtable that, when full, is flushed as a run sorted by digest, with a filter over its digests. Runs are compacted when
there are several, and the smallest id and the count survive. The tasks' runs are then dealt out by digest and merged in sorted order
into one entry per digest for the whole table. Digests of one text alone are done.

The others are hits and receive byte verification: a filter over the hit digests, sized by their number up to a bound, lets the second
scan pass on texts of hits only, and their normalised bytes are compared within each task first, then between the tasks' survivors, so
that a group of any size is never gathered. Should two texts share a digest, the groups of that digest are formed by the texts
themselves. Every row gets its entry by a join, in which the entries of very large groups are broadcast.

Nulls count as empty texts; texts of any length are hashed whole. Repeated rows are copies like any others: of rows that repeat an id
and a text one is kept, and rows that repeat an id with another text belong to that text's group. Rows with a null id are dropped, as
an id names a row here. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, cut, hot_keys, slices, spread_join, tidied

MEMTABLE = 50_000
RUNS = 4
#: Entries that a task's index holds before its run goes out, and characters that a task remembers for comparisons.
MOST_ENTRIES, MOST_LETTERS = 1_000_000, 64_000_000
#: Bits, at most, of a filter that is sent to every task: 8 MB. Beyond a quarter of that in digests there is no filter and all texts of
#: the table go through the comparison's shuffle.
HIT_BITS = 1 << 26
WHITE = r"[\x20\x09-\x0D]+"
KEY = "S16"  # digests are kept as 16 bytes


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def places(digests: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places in a filter for each digest, from the digest's own bytes."""
    words = np.frombuffer(digests.tobytes(), dtype="<u4").reshape(-1, 4)
    return [words[:, k].astype(np.int64) % bits for k in range(3)]


class Filter:
    """Three bits per digest, packed."""

    def __init__(self, bits: int, marks: np.ndarray | None = None):
        self.bits, self.marks = bits, np.zeros(bits // 8, dtype=np.uint8) if marks is None else marks

    def add(self, digests: np.ndarray) -> Filter:
        for p in places(digests, self.bits):
            np.bitwise_or.at(self.marks, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        return self

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(self.marks[p >> 3] >> (p & 7)) & 1 == 1 for p in places(digests, self.bits)])


def condensed(digests: np.ndarray, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry per digest, sorted: the smallest (id, row) and the sum of the counts."""
    order = np.lexsort((rows, ids, digests))
    digests, ids, rows, counts = digests[order], ids[order], rows[order], counts[order]
    first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]]) if len(digests) else np.empty(0, dtype=np.int64)
    return digests[first], ids[first], rows[first], np.add.reduceat(counts, first) if len(first) else counts


class Run:
    """Entries sorted by digest: smallest id, its row, and count of each, with a filter."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray):
        self.digests, self.ids, self.rows, self.counts = condensed(digests, ids, rows, counts)
        self.filter = Filter(max(64, 8 * len(self.digests))).add(self.digests)

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the digests the run holds, where): the filter first, then a binary search."""
        may = np.flatnonzero(self.filter.may_hold(digests)) if len(self.digests) else np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.digests, digests[may]), len(self.digests) - 1)
        held = self.digests[at] == digests[may] if len(may) else np.empty(0, dtype=bool)
        return may[held], at[held]

    def absorb(self, digests: np.ndarray, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds the entries, one per digest, whose digests the run holds, and says which these are."""
        found, at = self.find(digests)
        smaller = (ids[found] < self.ids[at]) | ((ids[found] == self.ids[at]) & (rows[found] < self.rows[at]))
        self.ids[at], self.rows[at] = np.where(smaller, ids[found], self.ids[at]), np.where(smaller, rows[found], self.rows[at])
        self.counts[at] += counts[found]
        taken = np.zeros(len(digests), dtype=bool)
        taken[found] = True
        return taken

    def get(self, digest: bytes) -> tuple[int, int] | None:
        _, at = self.find(np.array([digest], dtype=KEY))
        return (int(self.ids[at[0]]), int(self.counts[at[0]])) if len(at) else None


class DigestIndex:
    """Memtable and runs; merge order does not matter, as smallest ids and sums come out the same."""

    def __init__(self, memtable: int = MEMTABLE, runs: int = RUNS):
        self.memtable: dict[bytes, tuple[int, int, int]] = {}
        self.most, self.most_runs, self.runs = memtable, runs, []

    def __len__(self) -> int:
        return len(self.memtable) + sum(len(r.digests) for r in self.runs)

    def insert(self, digest: bytes, doc_id: int, count: int = 1, row: int = 0) -> None:
        held = self.memtable.get(digest)
        self.memtable[digest] = (doc_id, row, count) if held is None else (*min(held[:2], (doc_id, row)), held[2] + count)
        if len(self.memtable) >= self.most:
            self.flush()

    def insert_batch(self, digests: list[bytes], ids: list[int], rows: list[int], counts: list[int]) -> None:
        """Digests that a run holds, as its filter and then the run itself tell, are hits and change its entry; the others go to the
        memtable."""
        left = condensed(np.array(digests, dtype=KEY), *(np.array(x, dtype=np.int64) for x in (ids, rows, counts)))
        for run in self.runs:
            if len(left[0]):
                taken = run.absorb(*left)
                left = tuple(x[~taken] for x in left)
        for digest, i, row, n in zip(padded(left[0]), *(x.tolist() for x in left[1:]), strict=True):
            self.insert(digest, i, n, row)

    def flush(self) -> None:
        if self.memtable:
            values = np.array([*self.memtable.values()], dtype=np.int64)
            self.runs.append(Run(np.array([*self.memtable], dtype=KEY), *values.T))
            self.memtable = {}
        if len(self.runs) > self.most_runs:
            self.compact()

    def compact(self) -> None:
        if len(self.runs) > 1:
            self.runs = [Run(*(np.concatenate([getattr(r, k) for r in self.runs]) for k in ("digests", "ids", "rows", "counts")))]

    def get(self, digest: bytes) -> tuple[int, int] | None:
        held = self.memtable.get(digest)
        found = [x for x in (held and (held[0], held[2]), *(r.get(digest) for r in self.runs)) if x]
        return (min(x[0] for x in found), sum(x[1] for x in found)) if found else None

    def merged(self) -> Run:
        self.flush()
        self.compact()
        return self.runs[0] if self.runs else Run(np.empty(0, dtype=KEY), *[np.empty(0, dtype=np.int64)] * 3)


def padded(digests: np.ndarray) -> list[bytes]:
    """numpy drops trailing zero bytes of its fixed-length strings; they are put back."""
    return [d.ljust(16, b"\0") for d in digests.tolist()]


ENTRY = "digest binary, keep_id long, keep_row long, group_size long"


def entries(digests: np.ndarray, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(digests), 10_000):
        part = slice(at, at + 10_000)
        arrays = [pa.array(padded(digests[part]), type=pa.binary()), *(pa.array(x[part]) for x in (ids, rows, counts))]
        yield pa.RecordBatch.from_arrays(arrays, names=["digest", "keep_id", "keep_row", "group_size"])


def runs_of(rows: DataFrame, most: int) -> DataFrame:
    """Each task's compacted runs over rows (digest, id, row): one, or more where a task has more than `most` digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex()
        for batch in slices(batches, 10_000):
            digests, ids, numbers = columns_of(batch)
            index.insert_batch(digests, ids, numbers, [1] * len(ids))
            if len(index) >= most:
                out, index = index.merged(), DigestIndex()
                yield from entries(out.digests, out.ids, out.rows, out.counts)
        out = index.merged()
        yield from entries(out.digests, out.ids, out.rows, out.counts)

    return rows.mapInArrow(tidied(run), ENTRY)


def compacted(runs: DataFrame) -> DataFrame:
    """One entry per digest: the runs are dealt out by digest and merged as they come, sorted; a task holds a batch of them."""
    dealt = runs.repartition(F.col("digest")).sortWithinPartitions("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, 10_000):
            digests, *rest = columns_of(batch)
            new = (np.array(digests, dtype=KEY), *(np.array(x, dtype=np.int64) for x in rest))
            new = condensed(*(new if held is None else (np.concatenate(p) for p in zip(held, new, strict=True))))
            yield from entries(*(x[:-1] for x in new))
            held = tuple(x[-1:] for x in new)
        if held is not None:
            yield from entries(*held)

    return dealt.mapInArrow(tidied(run), ENTRY)


def build_index(digests: DataFrame, most: int | None = None) -> DataFrame:
    """An entry per digest of rows (digest, doc_id, row). A digest that many rows share has few entries per task when it is dealt out."""
    return compacted(runs_of(digests.select("digest", "doc_id", "row"), most or MOST_ENTRIES))


def hit_filter(digests: DataFrame, most: int) -> Filter | None:
    """Marks of the digests, eight bits for each up to `most` in all; None where that leaves fewer than four bits for each, and
    callers pass all rows on. Tasks send marks, never digests, and equal marks are merged before they arrive."""
    n = digests.count()
    if 4 * n > most:
        return None
    bits = min(most, 1 << max(16, (8 * n).bit_length()))
    slice_bytes = 1 << 13

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for batch in batches:
            if batch.num_rows:
                own.add(np.array(batch.column(0).to_pylist(), dtype=KEY))
        rows = [(k, row.tobytes()) for k, row in enumerate(own.marks.reshape(-1, slice_bytes)) if row.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.binary())], names=["slice", "marks"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(*columns_of(batch), strict=True):
                x = np.frombuffer(m, dtype=np.uint8)
                held[k] = held[k] | x if k in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([*held], type=pa.int64()), pa.array([x.tobytes() for x in held.values()], type=pa.binary())], names=["slice", "marks"])

    parts = digests.mapInArrow(tidied(marks), "slice long, marks binary").repartition(F.col("slice")).mapInArrow(tidied(merged), "slice long, marks binary")
    whole = np.zeros((bits // 8 // slice_bytes, slice_bytes), dtype=np.uint8)
    for row in parts.toLocalIterator():  # at most `most` bits in all
        whole[row["slice"]] = np.frombuffer(row["marks"], dtype=np.uint8)
    return Filter(bits, whole.reshape(-1))


def passing(wanted: Filter | None, spark) -> Callable[[list[bytes]], np.ndarray]:
    """A function for tasks: which of the digests may be wanted. The filter's size is bounded by the caller; without one all pass."""
    if wanted is None:
        return lambda digests: np.ones(len(digests), dtype=bool)
    sent, bits = spark.sparkContext.broadcast(wanted.marks.tobytes()), wanted.bits
    return lambda digests: Filter(bits, np.frombuffer(sent.value, dtype=np.uint8)).may_hold(np.array(digests, dtype=KEY))


def collisions(texts: DataFrame, hits: Filter | None) -> DataFrame:
    """Digests under which two different texts lie. texts: digest, norm. Each task compares bytes before anything is dealt out, with
    the first text of each digest, of which it remembers so many characters."""
    may_hold = passing(hits, texts.sparkSession)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, str] = {}
        letters = 0
        for batch in slices(batches):
            some = batch.filter(pa.array(may_hold(batch.column(0).to_pylist())))
            new = []
            for digest, norm in zip(*columns_of(some), strict=True):
                if digest not in seen:
                    seen[digest] = norm
                    letters += len(norm)
                    new.append((digest, norm))
                elif seen[digest] != norm:
                    new.append((digest, norm))
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in new], type=pa.binary()), pa.array([t for _, t in new], type=pa.string())], names=["digest", "norm"])
            if letters > MOST_LETTERS:
                seen, letters = {}, 0

    one_each = texts.mapInArrow(tidied(survivors), "digest binary, norm string")
    return one_each.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest")


def exact_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16, hit_bits: int = HIT_BITS) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept and text_sha256. digest_bytes: of the SHA-256, up to 16, in the index."""
    norm = documents.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm")).where("doc_id is not null")
    digest = F.concat(F.substring(F.unhex("text_sha256"), 1, digest_bytes), F.lit(bytes(16 - digest_bytes)))
    hashed = norm.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("digest", digest)
    rows = cut(hashed.select("doc_id", "digest", "text_sha256", F.monotonically_increasing_id().alias("row")))
    index = cut(build_index(rows))
    bad = cut(collisions(hashed.select("digest", "norm"), hit_filter(index.where("group_size > 1").select("digest"), hit_bits)))
    hot = hot_keys(index.withColumn("n", F.col("group_size")), "digest", rows.count())
    columns = ["digest", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"]
    found = spread_join(rows, index, "digest", hot).select(*columns)
    if not bad.isEmpty():  # digests of several texts: their groups are formed by the texts
        among = cut(hashed.join(bad, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()))
        groups = among.groupBy("norm").agg(F.min(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
        groups = groups.select("norm", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")
        found = found.join(bad, "digest", "left_anti").unionByName(among.join(groups, "norm").select(*columns))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
