"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Components become whole numbers. The postings (dimension, candidate, value) of a block of candidates are ordered by impact: those of
the magnitudes 4^b..4^(b+1)-1 are one segment, level b, ordered by dimension. A query's components have levels too, and a product of
levels a and b weighs 4^(a+b) to 4^(a+b+2), so segments are processed by descending a + b, for all queries of a batch at once: a
segment's postings are laid out by dimension and multiplied with the queries' parts of level a. After a step, what is left of any
score is bounded by the norms of the parts that were not yet multiplied (Cauchy-Schwarz, level by level). Processing stops only when
this proves that few enough candidates can still be among a query's k best; these possible members are then scored exactly. If no
proof comes, all segments are processed and the scores are exact.

The stated query set meets all rows in blocks. Blocks of queries of a checked total size are broadcast; a task then indexes its block
of candidates once, takes the queries batch by batch and yields the k best of each, and a window ranks them. Larger query sets go
through a grid of cells (block of queries, block of candidates), each of which is dealt out as a whole.

Vectors that are null or hold null or non-finite components take no part, nor do those with a component that is infinite after
scaling, or rows without an id. Scores beyond 64 bits are ranked exactly and given as the nearest 64-bit number. Vectors of different
lengths do not meet. Every row is a candidate, so a repeated id can be found several times; a query is all rows of an id, and these
are not candidates of it. If they differ, a candidate counts with the best score that any of them has. Ties go to the smaller id. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, cut

#: Vectors per block and queries that are multiplied at once; bytes of all queries up to which their blocks are broadcast.
CANDIDATES, QUERIES, BATCH, BROADCAST = 4_096, 4_096, 512, 64 << 20
BLOCK = "ids binary, vectors binary, dim int"
FOUND = "query_id long, vec_id long, score long, row long"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) per component, as whole numbers in doubles, or null if the vector takes no part."""
    scaled = F.transform(vector, lambda x: F.when(x.isNotNull(), F.lit(float(scale)) * x.cast("double")))
    bad = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rounded = lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)
    return F.when(vector.isNotNull() & ~bad, F.transform(scaled, rounded))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """One row per block of at most so many vectors of one length. Input: vec_id, q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dim: int):
            ids, vecs = zip(*held.pop(dim), strict=True)
            arrays = [np.array(ids, dtype="<i8").tobytes(), np.array(vecs, dtype="<f8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([a], type=pa.binary()) for a in arrays] + [pa.array([dim], type=pa.int32())], names=["ids", "vectors", "dim"])

        for batch in batches:
            for i, q in zip(*columns_of(batch), strict=True):
                held.setdefault(len(q), []).append((i, q))
                if len(held[len(q)]) >= rows:
                    yield flush(len(q))
        for dim in [*held]:
            yield flush(dim)

    return vectors.select("vec_id", "q").mapInArrow(run, BLOCK)


def read_block(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, dtype="<i8")
    return ids, np.frombuffer(vectors, dtype="<f8").reshape(len(ids), dim)


def level_of(x: np.ndarray) -> np.ndarray:
    """floor(log4(|x|)), and -1 for 0."""
    return (np.frexp(np.abs(x))[1].astype(np.int64) - 1) // 2


class ImpactIndex:
    """The postings of a block of candidates by level, and per candidate the norms of all that lies below each level."""

    def __init__(self, vectors: np.ndarray):
        self.shape, level = vectors.shape[::-1], level_of(vectors)
        self.top = int(level.max(initial=-1))
        doc, dim = np.nonzero(vectors)
        value, of = vectors[doc, dim], level[doc, dim]
        order = np.lexsort((doc, dim, -of))
        self.doc, self.dim, self.value = doc[order].astype(np.int32), dim[order].astype(np.int32), value[order]
        self.cuts = np.searchsorted(-of[order], -np.arange(self.top + 1), side="left"), np.searchsorted(-of[order], -np.arange(self.top + 1), side="right")
        square, self.below = np.zeros(len(vectors)), [np.zeros(len(vectors))]  # below[b]: norm of the components of levels under b
        for b in range(self.top + 1):
            at = slice(self.cuts[0][b], self.cuts[1][b])
            square = square + np.bincount(self.doc[at], weights=self.value[at] ** 2, minlength=len(vectors))
            self.below.append(np.sqrt(square))

    def segment(self, b: int, kind: type) -> np.ndarray:
        """The postings of a level laid out: a row per dimension."""
        at = slice(self.cuts[0][b], self.cuts[1][b])
        out = np.zeros(self.shape, dtype=kind)
        out[self.dim[at], self.doc[at]] = self.value[at]
        return out


def exact_scores(query: np.ndarray, vectors: np.ndarray, small: bool) -> np.ndarray:
    """Inner products as whole numbers of any size."""
    if small:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    whole = [int(x) for x in query.tolist()]
    return np.array([sum(a * int(b) for a, b in zip(whole, v, strict=True)) for v in vectors.tolist()] or [0], dtype=object)[: len(vectors)]


def possible_members(index: ImpactIndex, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, kind: type) -> tuple[np.ndarray, int, int]:
    """Which candidates (columns) can be among a query's (row's) k best, and how many of how many steps it took to know."""
    n, levels = len(vectors), level_of(queries)
    top = int(levels.max(initial=-1))
    parts = [np.where(levels == a, queries, 0).astype(kind) for a in range(top + 1)]
    norms = [np.sqrt((p.astype(np.float64) ** 2).sum(axis=1)) for p in parts]
    scores, segments, steps = np.zeros((len(queries), n), dtype=kind), {}, top + index.top + 1
    possible = ~own
    for s in range(top + index.top, -1, -1):  # descending impact
        for a in range(max(0, s - index.top), min(top, s) + 1):
            if norms[a].any():
                if s - a not in segments:
                    segments[s - a] = index.segment(s - a, kind)
                scores += parts[a] @ segments[s - a]
        if s > (top + index.top) // 2 and s > 0:
            continue  # too little is known yet for a proof
        rest = np.array(norms).T @ np.array([index.below[min(max(0, s - a), index.top + 1)] for a in range(top + 1)])
        rest = (rest * (1 + 1e-6) + 1e-3 * (s > 0)).astype(kind)  # rounding must not shrink a bound
        low = np.where(own, kind(-np.inf), scores - rest)
        kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(queries), -np.inf, dtype=kind)
        possible = ~own & (scores + rest >= kth[:, None] - 1)
        if possible.sum() <= 8 * k * len(queries):
            return possible, top + index.top - s + 1, steps
    return possible, max(0, steps), max(0, steps)


def search(vectors: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, index: ImpactIndex | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its id, and places, ids and scores of its k best candidates of the block."""
    own = query_ids[:, None] == ids[None, :]
    # sums of products must be exact in the accumulators; where not even doubles hold them, all candidates are scored in whole numbers
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if largest < 2**52:
        possible, _, _ = possible_members(index or ImpactIndex(vectors), vectors, queries, own, k, np.float32 if largest < 2**24 else np.float64)
    else:
        possible = ~own
    for i, query in enumerate(queries):
        members = np.flatnonzero(possible[i])
        exact = exact_scores(query, vectors[members], largest < 2**52)
        best = np.lexsort((ids[members], -exact))[:k] if largest < 2**52 else np.array(sorted(range(len(members)), key=lambda m: (-exact[m], ids[members[m]]))[:k], dtype=np.int64)
        yield int(query_ids[i]), members[best], ids[members[best]], exact[best]


def found_in(block: int, vectors: np.ndarray, ids: np.ndarray, query_blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND; a candidate's row is its block and place. The block is indexed once for all queries."""
    index = ImpactIndex(vectors)
    for query_ids, queries in query_blocks:
        for at in range(0, len(query_ids), BATCH):
            out = []
            for q, places, names, scores in search(vectors, queries[at : at + BATCH], query_ids[at : at + BATCH], ids, k, index):
                held = [min(max(int(s), -(2**63)), 2**63 - 1) for s in scores] if scores.dtype == object else scores
                out.append((np.full(len(places), q), names, np.array(held, dtype=np.int64), (np.int64(block) << 16) + places))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score", "row"])


def by_broadcast(candidates: DataFrame, queries: list, k: int) -> DataFrame:
    sent = candidates.sparkSession.sparkContext.broadcast([tuple(r) for r in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block, ids, vectors, dim = (c[0] for c in columns_of(batch.slice(at, 1)))
                ids, vectors = read_block(ids, vectors, dim)
                yield from found_in(block, vectors, ids, (read_block(*q) for q in sent.value if q[2] == dim), k)

    return candidates.select("block", "ids", "vectors", "dim").mapInArrow(run, FOUND)


def by_grid(candidates: DataFrame, queries: DataFrame, cells: int, k: int) -> DataFrame:
    """Each block of candidates once for each block of queries, and the other way round; a cell's two rows meet in one task."""
    numbered = queries.select(F.col("block").alias("of"), "dim")
    grid = cut(candidates.select("block", "dim").join(numbered, "dim").select("block", "of"))
    left = candidates.join(grid, "block").select("block", "of", F.lit(False).alias("query"), "ids", "vectors", "dim")
    right = queries.withColumnRenamed("block", "of").join(grid, "of").select("block", "of", F.lit(True).alias("query"), "ids", "vectors", "dim")
    dealt = left.union(right).repartition(cells, "block", "of").sortWithinPartitions("block", "of", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            for at in range(batch.num_rows):
                block, _, query, ids, vectors, dim = (c[0] for c in columns_of(batch.slice(at, 1)))
                if not query:
                    mine = read_block(ids, vectors, dim)
                else:
                    yield from found_in(block, mine[1], mine[0], iter([read_block(ids, vectors, dim)]), k)

    return dealt.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score of each query's k best; queries are the rows whose id `every` divides."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("q")).where("vec_id is not null and q is not null")
    numbered = lambda f: cut(f.withColumn("block", F.monotonically_increasing_id()))
    candidates, queries = numbered(blocks(rows, CANDIDATES)), numbered(blocks(rows.where(F.col("vec_id") % every == 0), QUERIES))
    many = candidates.count()
    size, blocks_of = queries.agg(F.coalesce(F.sum(F.length("vectors") + F.length("ids")), F.lit(0)), F.count("*")).first()
    if size <= BROADCAST:
        found = by_broadcast(candidates.repartition(max(1, many)), queries.select("ids", "vectors", "dim").collect(), k)
    else:
        found = by_grid(candidates, queries, min(many * blocks_of, 100_000), k)
    # rows of one id are one query: a candidate's best score counts
    best = found.groupBy("query_id", "row").agg(F.max(F.struct("score", "vec_id")).alias("b")) if has_repeats(rows, every) else found.select("query_id", F.struct("score", "vec_id").alias("b"))
    members = best.select("query_id", "b.vec_id", "b.score")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def has_repeats(rows: DataFrame, every: int) -> bool:
    return not rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").count().where("count > 1").isEmpty()
