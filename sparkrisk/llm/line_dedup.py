"""Line dedup with an edit join by partition into threshold-plus-one segments; the threshold grows with the lines.

Lines are ordered by (doc_id, place of the line's first occurrence in the document). An occurrence of a line goes if an equal line
occurs earlier, whatever its length, or, for lines of at least `least` characters, if a line within the threshold of it has its first
occurrence earlier. Blank lines (empty, or white space alone) part paragraphs and always stay. Two lines have a threshold of one edit
per `per` characters of the shorter one, and one edit at least; without `per` it is one edit for all.

Join for t > 1 edits, lines of 2 * per characters or more. If t + 1 segments of a line share no character, t edits leave one of them
whole, in both lines. Segments are grams of a fixed length; a line takes all grams whose hashes lie below a bound of its own, the least
(up to a step) below which t + 1 grams are disjoint. Of two lines within their threshold the one with the lower bound has a segment
that is whole in the other, and so is below the other's bound too: they share a segment, at a place that differs by t at most. Tasks
send their segments as arrays per bucket of keys, with the lines' sizes and the segments' places in cells, and a bucket yields the
pairs of lines that share a segment and whose sizes and places fit. Pairs that their letter counts do not rule out are verified, many
at once by their diagonals, few or very long ones with a bit-parallel edit distance in a band. The lines of a segment under which many lines of about one size lie are not paired up: those
tied together by such segments form a group, which is cut by size and then into cells of bounded size. In a cell each line meets the
earlier ones, those with the closest letter counts first, until one is near.

Join for one edit: it leaves one of a line's two segments whole. A line of length n is indexed under both its segments, with n; as a probe
of lines of length n - 1 it selects the one substring per segment that can still match there (from the begin for the first segment,
from the end for the second). Lines that share a key are candidates, and are verified likewise.

Keys that many lines share are not paired up: their lines go to a round with 16 segments, where one edit leaves 15 whole, so that a
key is a line without one segment; keys that still are shared by many go to a last round whose keys are the line without each one of
its characters, with the place kept for changes. Lines that share a key there are one edit apart, so each is verified against the
first of its key alone. Work thus stays linear in the
lines however many are alike, and no pair is lost: a pair shares a key in every round.

Equal lines are brought together by 128-bit hashes. Nulls in the id: the text stays as it is. Null texts stay null. Rows that repeat
an id count as one document: the same line stays in both. Other columns are kept, but for n_lines and n_dropped, which are replaced.
An empty table gives an empty result. Lines and texts of any length are handled whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, cut, drop, free_name, hot_keys, only, slices, spread_join, tidied
from .components import components
from .digest_index import HIT_BITS, Filter, hit_filter, passing
from .edit_pairs import Texts, first_near, letters_of

#: Characters of the shortest lines in the edit join.
LEAST_CHARS = 20
SEGMENTS = (2, 16)  # then one per character
MOST_IN_RUN = 64
LETTERS_AT_ONCE = 1 << 17
MOST_SEEN = 400_000
#: Characters per edit of the queries: a line of 250 characters may differ in 8, a word or two.
CHARS_PER_EDIT = 30
#: Lines, and their characters, that meet in one task.
CELL_LINES, CELL_LETTERS = 1_000, 8_000_000
#: Segments that a task sorts at once, and buckets of keys: these grow with the table's parts, within bounds.
SEGMENTS_AT_ONCE, LEAST_BUCKETS, MOST_BUCKETS, BUCKETS_PER_PART = 1_500_000, 4096, 1 << 15, 64
#: Characters whose grams are hashed at once, so that they stay in a core's cache.
GRAMS_AT_ONCE = 1 << 15
#: Steps of a line's share of grams, as multiples of the usual one: first those that nearly all lines do with, then the others.
SHARES = (0.7, 0.85, 1.0, 1.2, 1.5), (1.25**3, 1.25**4, 1.25**5)
#: Pairs, and characters of theirs, that are compared at once; pairs so few, or with a line so long, are compared one by one.
PAIRS_AT_ONCE, PAIR_LETTERS, FEW_PAIRS, LONGEST_AT_ONCE = 10_000, 4_000_000, 8, 4_096
BASE = 0x9E3779B97F4A7C15 | 1


def line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Substrings:
    """Hashes of any substrings of some lines, from one array of prefix sums."""

    def __init__(self, lines: list[str]):
        letters = letters_of(lines).astype(np.uint64) + np.uint64(1)
        up, self.down = powers(max(LETTERS_AT_ONCE, 1 << (len(letters) + 1).bit_length()))
        self.sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.cumsum(letters * up[: len(letters)], dtype=np.uint64, out=self.sums[1:])
        ends = np.cumsum([len(x) for x in lines])
        self.begin, self.end = ends - np.array([len(x) for x in lines]), ends

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]

    def key(self, begin, end, length, segments, left_out) -> np.ndarray:
        """Key of lines [begin, end) as lines of that length without one of their segments. A probe is one longer than that."""
        low, high = left_out * length // segments, (left_out + 1) * length // segments
        front, back = self.hash(begin, begin + low), self.hash(end - (length - high), end)
        place = (length.astype(np.uint64) << np.uint64(32)) ^ (np.asarray(segments).astype(np.uint64) << np.uint64(16)) * np.uint64(3) ^ np.asarray(left_out).astype(np.uint64)
        return mixed(mixed(front + np.uint64(1)) * np.uint64(3) + mixed(back ^ np.uint64(0x5851F42D4C957F2D)) + mixed(place)).view(np.int64)

    def keys(self, segments: int) -> np.ndarray:
        """A row per line: its index keys, then its probe keys."""
        n = self.end - self.begin
        return np.stack([self.key(self.begin, self.end, n - longer, segments, i) for longer in (0, 1) for i in range(segments)], axis=1)

    def keys_by_letter(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For one line: keys that only lines with one character changed, or one put in, share with it; and those of the line with
        each one of its characters taken out, which meet the whole line's key."""
        n = int(self.end[k] - self.begin[k])
        place, begin, end = np.arange(n), np.full(n, self.begin[k]), np.full(n, self.end[k])
        changed = self.key(begin, end, np.full(n, n), n, place)
        whole = self.hash(begin[:1], end[:1])
        without = self.hash(begin, begin + place) + self.hash(begin + place + 1, end) * powers_of(place)
        of_length = lambda h, size: mixed(mixed(h ^ np.uint64(0xD1B54A32D192ED03)) + np.uint64(size)).view(np.int64)
        return np.r_[changed, of_length(whole, n)], of_length(without, n - 1)


def powers_of(place: np.ndarray) -> np.ndarray:
    return powers(max(LETTERS_AT_ONCE, 1 << len(place).bit_length()))[0][place]


def batches_of(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about LETTERS_AT_ONCE characters."""
    begin = size = 0
    for k, line in enumerate(lines):
        if size and size + len(line) >= LETTERS_AT_ONCE:
            yield begin, k
            begin, size = k, 0
        size += len(line)
    if begin < len(lines):
        yield begin, len(lines)


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def distance(a: str, b: str) -> int:
    """The edit distance, by bit vectors of b's length, one step per character of a."""
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    mask, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    more, less, found = mask, 0, len(b)
    for c in a:
        same = places.get(c, 0)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up = less | (~(across | more) & mask)
        back = more & across
        found += 1 if up & top else -1 if back & top else 0
        up, back = (up << 1 | 1) & mask, back << 1 & mask
        more, less = back | (~(down | up) & mask), up & down
    return found


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`, by bit vectors of the band around the diagonal, one step per character."""
    front = common_prefix(a, b)
    a, b = a[front:], b[front:]
    back = common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - back], b[: len(b) - back]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    if not b or max(len(a), len(b)) <= most:
        return len(a) <= most
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    # bit `width - 1` of a vector is the diagonal's lower edge: row j + most of a in step j; lower bits are the rows above it
    width = 2 * most + 2
    mask, edge = (1 << width) - 1, 1 << (width - 1)
    more, less, found, last = mask ^ ((1 << (width - most - 1)) - 1), 0, most, len(a) - 1
    limit = 2 * most + len(b) - len(a)
    for j, c in enumerate(b):
        shift = j + most + 1 - width
        same = places.get(c, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & mask
        down = ((((same & more) + more) ^ more) | same | less) & mask
        across = (less | ~(down | more)) & mask
        back_ = down & more
        row = j + most
        if row <= last:  # along the lower edge of the band
            found += not down & edge
        else:  # along a's last row
            bit = 1 << (width - 1 - (row - last))
            found += bool(across & bit) - bool(back_ & bit)
        if found > limit:
            return False
        down >>= 1
        more, less = (back_ | ~(down | across)) & mask, down & across
    return found <= most


def late_of(late: np.ndarray, early: np.ndarray, gap: np.ndarray, most: np.ndarray, texts: list[str]) -> np.ndarray:
    """The texts in `late`, by number, that are within `most` edits of one of theirs in `early`; those of the least gap count first."""
    order = np.lexsort((gap, late))
    late, early, most = late[order], early[order], most[order]
    size = np.array([len(x) for x in texts], dtype=np.int64)
    long = size > LONGEST_AT_ONCE

    def near(some: np.ndarray) -> np.ndarray:
        a, b, t = late[some], early[some], most[some]
        out, alone = np.zeros(len(some), dtype=bool), long[a] | long[b] | (len(some) <= FEW_PAIRS)
        together = np.flatnonzero(~alone)
        part = np.cumsum(size[a[together]] + size[b[together]]) // PAIR_LETTERS
        for some in np.split(together, np.flatnonzero(np.diff(part)) + 1) if len(together) else ():
            used, at = np.unique(np.concatenate([a[some], b[some]]), return_inverse=True)
            out[some] = Texts([texts[k] for k in used.tolist()]).within(*at.reshape(2, -1), t[some])
        out[alone] = [within(texts[i], texts[j], k) for i, j, k in zip(a[alone].tolist(), b[alone].tolist(), t[alone].tolist(), strict=True)]
        return out

    return first_near(late, near)


def blank(line: str) -> bool:
    return not line or line.isspace()


OCCURRENCE = "line binary, doc_id long, line_no int, size int, keys array<long>"


def occurrences(texts: DataFrame, least: int, per: int | None = None) -> DataFrame:
    """The first occurrence of each line in each document; with the line's keys for one edit where the task has not met the line
    before and the line takes part in the edit join with that threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            ids, docs, numbers, lengths, new, keyed = [], [], [], [], [], []
            for doc, text in zip(*columns_of(batch), strict=True):
                own = set()
                for no, line in enumerate(text.split("\n")):
                    if not blank(line) and (i := line_id(line)) not in own:
                        own.add(i)
                        ids.append(i), docs.append(doc), numbers.append(no), lengths.append(len(line))
                        keyed.append(i not in seen and len(line) >= least and (per is None or len(line) <= 2 * per))
                        if keyed[-1]:
                            seen.add(i)
                            new.append(line)
            parts = [Substrings(new[a:b]).keys(SEGMENTS[0]) for a, b in batches_of(new)]
            keys = np.concatenate(parts) if parts else np.empty((0, 2 * SEGMENTS[0]), dtype=np.int64)
            sizes = np.where(keyed, keys.shape[1], 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], type=pa.int32()), pa.array(keys.reshape(-1)))
            columns = [pa.array(ids, type=pa.binary()), pa.array(docs, type=pa.int64()), pa.array(numbers, type=pa.int32()), pa.array(lengths, type=pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["line", "doc_id", "line_no", "size", "keys"])
            if len(seen) > MOST_SEEN:
                seen.clear()

    return texts.mapInArrow(tidied(run), OCCURRENCE)


def lines_among(texts: DataFrame, wanted: Filter | None, least: int) -> DataFrame:
    """(line, text) of the lines that the filter lets through, once per task."""
    may_hold = passing(wanted, texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            lines = list(dict.fromkeys(x for text in batch.column(1).to_pylist() for x in text.split("\n") if len(x) >= least))
            ids = [line_id(x) for x in lines]
            hit = may_hold(ids) if ids else []
            found = [(i, x) for i, x, h in zip(ids, lines, hit, strict=True) if h and i not in seen]
            seen.update(i for i, _ in found)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], type=pa.binary()), pa.array([x for _, x in found], type=pa.string())], names=["line", "text"])
            if len(seen) > MOST_SEEN:
                seen.clear()

    return texts.mapInArrow(tidied(run), "line binary, text string")


def shared(keys: DataFrame) -> DataFrame:
    """(key, line, many) of the keys under which different lines lie, each line once however many tasks have met it."""
    keys = keys.distinct()
    hashed = keys.withColumn("h", F.xxhash64("line"))
    runs = hashed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n")).where("low <> high")
    return keys.join(runs.select("key", (F.col("n") > MOST_IN_RUN).alias("many")), "key").select("key", "line", "many")


def later_in_run(entries: DataFrame) -> DataFrame:
    """The lines that have an earlier line within one edit under the same key. entries: key, doc_id, line_no, line, text."""
    order = ["key", "doc_id", "line_no", "line"]
    dealt = entries.select(*order, "text").repartition(F.col("key")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in slices(batches):
            out = []
            for key, _, _, line, text in zip(*columns_of(batch), strict=True):
                if key != last:
                    last, held = key, {}
                if line not in held:
                    if any(within(text, other, 1) for other in held.values()):
                        out.append(line)
                    held[line] = text
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["line"])

    return dealt.mapInArrow(tidied(run), "line binary")


def keys_of(lines: DataFrame, segments: int) -> DataFrame:
    """(key, line) of lines given with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = columns_of(batch)
            for a, b in batches_of(texts):
                keys = Substrings(texts[a:b]).keys(segments)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array([i for i in ids[a:b] for _ in range(keys.shape[1])], type=pa.binary())], names=["key", "line"])

    return lines.select("line", "text").mapInArrow(tidied(run), "key long, line binary")


def letter_keys(lines: DataFrame) -> DataFrame:
    """(key, line, probe): the keys of the last round; probes are the lines without one character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for line, text in zip(*columns_of(batch), strict=True):
                index, probe = Substrings([text]).keys_by_letter(0)
                n = len(index) + len(probe)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[index, probe]), pa.array([line] * n, type=pa.binary()), pa.array(np.arange(n) >= len(index))], names=["key", "line", "probe"])

    return lines.select("line", "text").mapInArrow(tidied(run), "key long, line binary, probe boolean")


def later_by_letter(pool: DataFrame) -> DataFrame:
    """The last round: each line is verified against the earliest indexed line, and the earliest probe, of each of its keys."""
    place = F.struct("doc_id", "line_no", "line")
    keyed = letter_keys(pool).join(pool.select("line", "doc_id", "line_no"), "line")
    firsts = keyed.groupBy("key").agg(F.min(F.when(~F.col("probe"), place)).alias("indexed"), F.min(F.when(F.col("probe"), place)).alias("probing"))
    pairs = keyed.join(firsts, "key").withColumn("other", F.when(F.col("probe"), F.col("indexed")).otherwise(F.least("indexed", "probing")))
    pairs = pairs.where(F.col("other") < place).select("line", F.col("other.line").alias("first")).distinct()
    texts = pool.select("line", "text")
    both = pairs.join(texts, "line").join(texts.select(F.col("line").alias("first"), F.col("text").alias("first_text")), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [line for line, a, b in zip(*columns_of(batch), strict=True) if within(a, b, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["line"])

    return both.select("line", "text", "first_text").mapInArrow(tidied(run), "line binary")


def near_lines(found: DataFrame, texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """The lines that have an earlier line, another one, within one edit. found: what shared() gives; texts: of its lines, and others."""
    wanted = found.select("line").distinct()
    pool = cut(texts.join(wanted, "line", "left_semi").join(firsts.select("line", "doc_id", "line_no"), "line"))
    late = later_in_run(found.where("not many").join(pool, "line"))
    hot = pool.join(found.where("many").select("line").distinct(), "line", "left_semi")
    for segments in SEGMENTS[1:]:
        again = cut(shared(keys_of(hot, segments)))
        late = late.union(later_in_run(again.where("not many").join(pool, "line")))
        hot = pool.join(again.where("many").select("line").distinct(), "line", "left_semi")
    return late.union(later_by_letter(cut(hot))).distinct()


def edits(size, per: int):
    return np.maximum(1, size // per)


def gram_size(per: int) -> int:
    """Characters of a segment: few enough that threshold-plus-one of them always find room in a line."""
    return max(1, 8 * per // 15)


def disjoint(places: np.ndarray, begin: np.ndarray, end: np.ndarray, need: np.ndarray, q: int) -> np.ndarray:
    """How many grams of q characters that share none a line has, up to `need`; places are sorted, a line has those in [begin, end)."""
    count, at, stop = np.zeros(len(begin), dtype=np.int64), np.searchsorted(places, begin), np.searchsorted(places, end)
    after = np.searchsorted(places, places + q)  # the next gram that shares no character with this one
    live = np.flatnonzero(at < stop)
    at, stop, steps = at[live], stop[live], 0
    while len(live):
        steps += 1
        at = after[at]
        done = (at >= stop) | (need[live] <= steps)
        if done.any():
            count[live[done]] = steps
            live, at, stop = live[~done], at[~done], stop[~done]
    return count


def grams(lines: list[str], q: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place in all letters) of the grams of q characters with a hash of 63 bits up to the limit; some run over a line's end."""
    letters = letters_of(lines)
    up, down = powers(max(GRAMS_AT_ONCE, q) + q)
    hashes, places = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for at in range(0, len(letters) - q + 1, GRAMS_AT_ONCE):
        some = letters[at : at + GRAMS_AT_ONCE + q - 1].astype(np.uint64)
        some += np.uint64(1)
        some *= up[: len(some)]
        sums = np.zeros(len(some) + 1, dtype=np.uint64)
        np.cumsum(some, out=sums[1:])
        h = sums[q:] - sums[:-q]
        h *= down[: len(h)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h >>= np.uint64(1)  # keeps bounds within the range of whole numbers
        low = np.flatnonzero(h <= np.uint64(limit))
        hashes.append(h[low])
        places.append(low + at)
    return np.concatenate(hashes), np.concatenate(places)


def bounds(share: np.ndarray) -> np.ndarray:
    """The hashes below which that share of all grams lies."""
    return (np.minimum(share, 1.0) * 2.0**63).astype(np.uint64)


def segments(lines: list[str], per: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, place) of each line's segments: its grams with a hash below the line's bound, where the bound is (up to a step) the
    least one below which threshold-plus-one grams share no character."""
    keys, lines_of, places, rest = bounded_segments(lines, per, q, SHARES[0])
    parts = [(keys, lines_of, places)]
    if len(rest):  # lines that need a larger share of their grams
        *some, again = bounded_segments([lines[k] for k in rest.tolist()], per, q, SHARES[1])
        parts.append((some[0], rest[some[1]], some[2]))
        if len(again):  # lines that repeat themselves: all their grams
            every = [grams([lines[k]], q, (1 << 63) - 1) for k in rest[again].tolist()]
            parts += [(h, np.full(len(h), k), at) for k, (h, at) in zip(rest[again].tolist(), every, strict=True)]
    keys, lines_of, places = (np.concatenate(x) for x in zip(*parts, strict=True))
    return mixed(keys ^ np.uint64(0x2545F4914F6CDD1D)), lines_of, places


def bounded_segments(lines: list[str], per: int, q: int, shares: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """(hash, line, place) with the first of these multiples of the usual share of grams that suffices, and the lines where none does."""
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    end = np.cumsum(sizes)
    begin, need = end - sizes, sizes // per + 1
    usual = np.minimum(1.0, 1.0 / np.maximum(1.0, sizes / need - q))  # share of grams at which this many are disjoint, on average
    h, at = grams(lines, q, int(bounds(shares[-1] * usual.max(initial=0))))
    of = np.repeat(np.arange(len(lines)), np.diff(np.searchsorted(at, end), prepend=0))
    inside = at <= (end - q)[of]
    h, at, of = h[inside], at[inside], of[inside]
    bound = np.zeros(len(lines), dtype=np.uint64)
    live = np.ones(len(lines), dtype=bool)
    h_live, of_live, at_live = h, of, at
    for share in shares:
        limit = bounds(share * usual)
        found = disjoint(at_live[h_live < limit[of_live]], begin[live], end[live], need[live], q)
        done = np.flatnonzero(live)[found >= need[live]]
        bound[done] = limit[done]
        live[done] = False
        if not live.any():
            break
        left = live[of_live]
        h_live, of_live, at_live = h_live[left], of_live[left], at_live[left]
    picked = h < bound[of]
    return h[picked], of[picked], at[picked] - begin[of[picked]], np.flatnonzero(live)


def width_of(size: np.ndarray, per: int) -> np.ndarray:
    """Characters per cell: a power of two that is no less than the threshold. Places are kept as numbers of cells."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(1, size // per))).astype(np.int64))


#: Sizes and cells are kept in two bytes and one; what is larger is taken as that, and meets all that may be near.
MOST_SIZE, MOST_CELL = (1 << 16) - 1, 255


def cells_of(place: np.ndarray, size: np.ndarray, per: int) -> np.ndarray:
    return np.minimum(place // width_of(np.minimum(size, MOST_SIZE), per), MOST_CELL).astype(np.uint8)


def ref_of(line: str, size: int) -> int:
    """48 bits for a line: its size and the begin of its id."""
    return (size if size < MOST_SIZE else MOST_SIZE) << 32 | xxhash.xxh3_128_intdigest(line.encode()) >> 96


#: Bytes of a segment as it is sent, a column after the other as most sizes begin alike: 24 bits of its key beside the bucket (keys that
#: agree in these by chance make pairs that are ruled out later), of its line's ref what the size does not tell, the size's two, the cell.
KEY, REF, LOW, HIGH, CELL = WIDTHS = 3, 4, 1, 1, 1
SEGMENT = sum(WIDTHS)
PACKED = "bucket long, rows binary"


def dealt(key: np.ndarray, ref: np.ndarray, size: np.ndarray, cell: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The segments as one string per bucket."""
    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)  # buckets stay below 2^16
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    there = np.flatnonzero(counts)
    ends = np.r_[0, np.cumsum(counts[there])]
    first = lambda x, kind, n: x[order].astype(kind).view(np.uint8).reshape(len(x), -1)[:, :n]
    sizes = first(size, "<u2", 2)
    columns = first(key, "<u4", KEY), first(ref, "<u4", REF), sizes[:, :LOW], sizes[:, LOW:], first(cell, "u1", CELL)
    strings = [pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer((ends * n).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x, n in zip(columns, WIDTHS, strict=True)]
    rows = pc.binary_join_element_wise(*strings, pa.scalar(b"", type=pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), rows], names=["bucket", "rows"])


def unpacked(strings: list[bytes]) -> tuple[np.ndarray, ...]:
    """(key, ref, size, cell) of what dealt() has packed."""
    columns, at = [], 0
    for n in WIDTHS:
        part = b"".join(x[at * len(x) // SEGMENT : (at + n) * len(x) // SEGMENT] for x in strings)
        columns.append(np.frombuffer(part, dtype=np.uint8).reshape(-1, n))
        at += n
    key, ref, low, high, cell = columns
    key = key[:, 0] | key[:, 1].astype(np.int64) << 8 | key[:, 2].astype(np.int64) << 16
    return key, ref.reshape(-1).view("<u4"), low[:, 0] | high[:, 0].astype(np.int64) << 8, cell[:, 0]


def packed_segments(texts: DataFrame, least: int, per: int, q: int, buckets: int) -> DataFrame:
    """The segments of all lines with a threshold of two edits or more, once per task, packed into a row per bucket of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        shortest, count = max(least, 2 * per), 0
        for batch in slices(batches):
            new: dict[int, str] = {}
            for text in batch.column(1).to_pylist():
                for line in text.split("\n"):
                    if (n := len(line)) >= shortest and (ref := ref_of(line, n)) not in seen:
                        seen.add(ref)
                        new[ref] = line
            by_size = sorted(new)  # refs begin with the size; lines of one size need about the same share of their grams
            lines, refs = [new[r] for r in by_size], np.array(by_size, dtype=np.int64).astype(np.uint32)
            for a, b in batches_of(lines):
                key, of, place = segments(lines[a:b], per, q)
                size = np.array([len(x) for x in lines[a:b]], dtype=np.int64)[of]
                cell = cells_of(place, size, per)
                fresh = np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])]  # a line may repeat itself
                held.append((key[fresh], refs[a:b][of[fresh]], np.minimum(size, MOST_SIZE)[fresh], cell[fresh]))
                count += len(held[-1][0])
                if count >= SEGMENTS_AT_ONCE:
                    yield dealt(*map(np.concatenate, zip(*held, strict=True)), buckets)
                    held, count = [], 0
            if len(seen) > MOST_SEEN:
                seen.clear()
        if count:
            yield dealt(*map(np.concatenate, zip(*held, strict=True)), buckets)

    return texts.mapInArrow(tidied(run), PACKED)


MEETING = "a long, b long, many boolean"


def meetings(segments_of: DataFrame, per: int) -> DataFrame:
    """(a, b, many): refs of different lines with a segment in common whose sizes and places allow that they are near. Of a segment
    that has more than MOST_IN_RUN lines of about one size, each line with the next by size instead, marked as many."""
    by_bucket = segments_of.repartition(F.col("bucket")).sortWithinPartitions("bucket")

    def pairs_of(buckets: list[int], strings: list[bytes]) -> pa.RecordBatch:
        key, ref, size, cell = unpacked(strings)
        place = np.repeat(np.array(buckets, dtype=np.int64) << 48, [len(x) // SEGMENT for x in strings])  # buckets stay below 2^15
        place |= key << 16
        place |= size
        order = np.argsort(place)
        key = place[order] >> 16
        alike = key[1:] == key[:-1]
        order = order[np.r_[False, alike] | np.r_[alike, False]]  # most segments are those of one line
        place, size, cell = place[order], size[order], cell[order]
        key, ref = place >> 16, size << 32 | ref[order]
        edits_of, wide = size // per, width_of(size, per)
        low = cell * wide
        high = np.where(cell == MOST_CELL, np.int64(1 << 60), low + wide - 1)
        # a row's window: the rows behind it with the same key and a size within the row's threshold
        counts = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]) if len(key) else np.empty(0, dtype=np.int64)
        last = np.repeat(np.cumsum(counts), counts)
        live, found = np.flatnonzero(last - np.arange(len(key)) > 1), []
        for k in range(1, MOST_IN_RUN + 1):
            live = live[live + k < last[live]]
            live = live[size[live + k] - size[live] <= edits_of[live]]
            if not len(live):
                break
            # places allow that the lines are near, or the sizes are not kept
            other, t = live + k, edits_of[live]
            ok = (ref[live] != ref[other]) & ((low[live] - high[other] <= t) & (low[other] - high[live] <= t) | (size[live] == MOST_SIZE))
            found.append((live[ok], other[ok]))
        dense = np.zeros(len(key), dtype=bool)  # rows with too many in their windows, whose pairs are found in cells
        dense[live] = True
        a, b = (np.concatenate([*x, np.empty(0, dtype=np.int64)]) for x in (zip(*found, strict=True) if found else ((), ())))
        few = ~dense[a]
        cover = np.zeros(len(key) + 1, dtype=np.int64)
        np.add.at(cover, live, 1)
        np.add.at(cover, np.minimum(np.searchsorted(place, place[live] + edits_of[live], side="right"), last[live]) - 1, -1)
        chain = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        chain = chain[ref[chain] != ref[chain + 1]]
        lines, number = np.unique(ref, return_inverse=True)
        each = []
        for x, y in ((a[few], b[few]), (chain, chain + 1)):
            x, y = number[x], number[y]
            each.append(np.unique(np.minimum(x, y) * len(lines) + np.maximum(x, y)))
        both = np.concatenate(each)
        x, y = np.divmod(both, max(1, len(lines)))
        return pa.RecordBatch.from_arrays([pa.array(lines[x]), pa.array(lines[y]), pa.array(np.arange(len(both)) >= len(each[0]))], names=["a", "b", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: list[int] = []
        strings: list[bytes] = []
        size = 0
        for batch in slices(batches):
            for bucket, rows in zip(*columns_of(batch), strict=True):
                if size >= SEGMENTS_AT_ONCE // 8 and bucket != buckets[-1]:  # several buckets at once, and each one whole
                    yield pairs_of(buckets, strings)
                    buckets, strings, size = [], [], 0
                buckets.append(bucket)
                strings.append(rows)
                size += len(rows) // SEGMENT
        if buckets:
            yield pairs_of(buckets, strings)

    return by_bucket.mapInArrow(tidied(run), MEETING)


LETTERS = 32


def letter_counts(texts: list[str]) -> np.ndarray:
    """A row per text: counts, up to 255, of characters, and of pairs of characters, in classes."""
    out = np.zeros((len(texts), 2, LETTERS), dtype=np.uint8)
    for a, b in batches_of(texts):
        x = letters_of(texts[a:b]).astype(np.uint32)
        of = np.repeat(np.arange(b - a), [len(t) for t in texts[a:b]])
        pairs = x[1:] * np.uint32(0x9E3779B1) + x[:-1]
        pairs = (pairs ^ pairs >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(16)
        inside = of[1:] == of[:-1]
        for k, (line, kind) in enumerate(((of, x), (of[1:][inside], pairs[inside]))):
            counts = np.bincount(line * LETTERS + kind % np.uint32(LETTERS), minlength=(b - a) * LETTERS)
            out[a:b, k] = np.minimum(counts, 255).reshape(b - a, LETTERS)
    return out.reshape(len(texts), 2 * LETTERS)


def counts_of(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, 2 * LETTERS).astype(np.int16)


def far(counts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A lower bound of the edits between lines, row by row: an edit changes two counts of characters by one, and four of pairs."""
    gap = np.abs(others - counts)
    return np.maximum((gap[:, :LETTERS].sum(axis=1) + 1) // 2, (gap[:, LETTERS:].sum(axis=1) + 3) // 4)


def with_counts(pool: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            counts = [x.tobytes() for x in letter_counts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], type=pa.int32()), pa.array(counts, type=pa.binary())], names=["line", "size", "counts"])

    return pool.select("line", "text").mapInArrow(tidied(run), "line binary, size int, counts binary")


def verified(pairs: DataFrame, facts: DataFrame, pool: DataFrame, per: int) -> DataFrame:
    """The later lines of the pairs (a, b) that are within their threshold. Letter counts rule out most before texts are brought in."""
    side = lambda s: facts.select(F.col("ref").alias(s), F.struct("doc_id", "line_no", "line", "size", "counts").alias(f"at_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    late, first = F.greatest("at_a", "at_b"), F.least("at_a", "at_b")
    flat = both.select(*[x[c].alias(f"{c}_{k}") for k, x in (("x", late), ("y", first)) for c in ("line", "size", "counts")])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 10_000):
            if batch.num_rows:
                size = np.minimum(batch.column(1).to_numpy(), batch.column(4).to_numpy())
                gap = far(counts_of(batch.column(2).to_pylist()), counts_of(batch.column(5).to_pylist()))
                ok = (gap <= edits(size, per)) & (np.abs(batch.column(1).to_numpy() - batch.column(4).to_numpy()) <= edits(size, per))
                some = batch.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(3), pa.array(gap[ok], type=pa.int32())], names=["line", "other", "gap"])

    left = flat.mapInArrow(tidied(near), "line binary, other binary, gap int").distinct()
    texts = pool.select("line", "text")
    # merged by the later line, so that its pairs lie together and end with the first one that is near
    both = left.join(texts.select(F.col("line").alias("other"), F.col("text").alias("other_text")), "other").join(texts.hint("merge"), "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, PAIRS_AT_ONCE):
            lines = batch.column(0).to_pylist()
            begin = [k for k in range(len(lines)) if not k or lines[k] != lines[k - 1]]
            own, others = [batch.column(2)[k].as_py() for k in begin], batch.column(3).to_pylist()
            late = np.repeat(np.arange(len(begin)), np.diff([*begin, len(lines)]))
            most = edits(np.minimum(np.array([len(x) for x in own], dtype=np.int64)[late], [len(x) for x in others]), per)
            some = np.flatnonzero(late >= (1 if lines and lines[0] == last else 0))  # a line found in the last batch is settled
            found = late_of(late[some], len(own) + some, batch.column(1).to_numpy()[some], most[some], own + others)
            if lines:
                last = lines[-1] if len(begin) - 1 in found or lines[-1] == last else None
            yield pa.RecordBatch.from_arrays([pa.array([lines[begin[k]] for k in found.tolist()], type=pa.binary())], names=["line"])

    return both.select("line", "gap", "text", "other_text").mapInArrow(tidied(run), "line binary").distinct()


def late_in_cells(edges: DataFrame, facts: DataFrame, pool: DataFrame, per: int) -> DataFrame:
    """The lines that have an earlier line within their threshold, for lines that common segments tie together: each group of them is
    cut into classes of size of which a line meets its own and the next, and these into a grid of cells of bounded size."""
    groups = components(edges).select(F.col("node").alias("ref"), F.col("component").alias("group"))
    members = cut(facts.join(groups, "ref").select("group", "line", "doc_id", "line_no", "size", F.floor(F.log("size") / math.log1p(1.2 / per)).cast("int").alias("own")))
    placed = members.select("*", F.explode(F.array("own", F.col("own") + 1)).alias("class"))
    sizes = placed.groupBy("group", "class").agg(F.greatest(F.ceil(F.count("*") / CELL_LINES), F.ceil(F.sum("size") / CELL_LETTERS)).cast("int").alias("parts"), F.max(F.col("own") == F.col("class")).alias("any"))
    dealt = placed.join(sizes.where("any").drop("any"), ["group", "class"]).withColumn("part", F.expr("pmod(xxhash64(line), parts)").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("group", "class", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("r"), "doc_id", "line_no", "line", (F.col("own") == F.col("class")).alias("own"), "part")
    cell, order = ["group", "class", "p", "r"], ["doc_id", "line_no", "line"]
    # a stated number of partitions is not merged by size: cells are small in bytes, but not in work
    tasks = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.join(pool.select("line", "text"), "line").select(*cell, *order, "own", "part", "text").repartition(tasks, *cell).sortWithinPartitions(*cell, *order)

    def pairs_of(rows: list[tuple]) -> tuple:
        """The lines of a cell, their texts, and its pairs (later, earlier, gap, threshold) that sizes and letter counts allow."""
        lines, own, part, texts = zip(*(r[6:] for r in rows), strict=True)
        size, own, part, counts = np.array([len(t) for t in texts]), np.array(own), np.array(part), letter_counts(texts).astype(np.int16)
        t = np.minimum(size[:, None], size[None, :]) // per
        fit = np.tril(np.abs(size[:, None] - size[None, :]) <= t, -1) & (own[:, None] | own[None, :])
        if rows[0][2] != rows[0][3]:
            fit &= part[:, None] != part[None, :]
        # an edit moves counts of characters by a vector of length 1.5 at most, and those of pairs by one of length 3
        for some, length in ((counts[:, :LETTERS], 1.5), (counts[:, LETTERS:], 3.0)):
            x = some.astype(np.float32)
            square = (x * x).sum(axis=1)
            fit &= square[:, None] + square[None, :] - 2 * (x @ x.T) <= (length * t) ** 2
        late, early = np.nonzero(fit)
        gap = np.concatenate([far(counts[late[k : k + 10_000]], counts[early[k : k + 10_000]]) for k in range(0, len(late), 10_000)] or [late])
        near = gap <= t[late, early]
        late, early, gap = late[near], early[near], gap[near]
        return lines, texts, late, early, gap, t[late, early]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cells: list[tuple] = []
        pairs = letters = 0

        def found() -> pa.RecordBatch:
            """Of several cells at once, as most are small."""
            lines, texts = ([x for c in cells for x in c[k]] for k in (0, 1))
            at = np.cumsum([0, *(len(c[0]) for c in cells[:-1])])
            late, early = (np.concatenate([c[k] + a for c, a in zip(cells, at, strict=True)]) for k in (2, 3))
            out = late_of(late, early, *(np.concatenate([c[k] for c in cells]) for k in (4, 5)), texts)
            cells.clear()
            return pa.RecordBatch.from_arrays([pa.array([lines[k] for k in out.tolist()], type=pa.binary())], names=["line"])

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal pairs, letters
            cells.append(pairs_of(held))
            held.clear()
            pairs, letters = pairs + len(cells[-1][2]), letters + sum(map(len, cells[-1][1]))
            if pairs >= PAIRS_AT_ONCE or letters >= CELL_LETTERS // 4:
                yield found()
                pairs = letters = 0

        for batch in slices(batches):
            for row in zip(*columns_of(batch), strict=True):
                if held and row[:4] != held[0][:4]:
                    yield from closed()
                held.append(row)
        if held:
            yield from closed()
        if cells:
            yield found()

    return rows.mapInArrow(tidied(run), "line binary").distinct()


def met_lines(texts: DataFrame, least: int, per: int) -> DataFrame:
    """(a, b, many): what meetings() gives for all lines with a threshold of two edits or more, once."""
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, BUCKETS_PER_PART * texts.rdd.getNumPartitions()))
    return meetings(packed_segments(texts, least, per, gram_size(per), buckets), per).distinct()


def near_long_lines(met: DataFrame, wanted: DataFrame, texts: DataFrame, per: int) -> DataFrame:
    """The lines that have an earlier line within a threshold of two edits or more. wanted: the lines of `met`; texts: of these, and others."""
    facts = cut(wanted.join(with_counts(texts.where(F.length("text") >= 2 * per)), "line"))
    late = verified(met.where("not many").select("a", "b"), facts, texts, per)
    edges = met.where("many").select("a", "b")
    return late if edges.isEmpty() else late.union(late_in_cells(edges, facts, texts, per))


def near_any(texts: DataFrame, occurring: DataFrame, firsts: DataFrame, met: DataFrame | None, least: int, bits: int, per: int | None) -> DataFrame:
    """The lines that have an earlier line within their threshold. met: what met_lines() gives, where thresholds grow. Texts are scanned
    once for the lines that may have one."""
    found = cut(shared(occurring.where("size(keys) > 0").select(F.explode("keys").alias("key"), "line")))
    wanted = found.select("line")
    if per is not None:
        numbered = firsts.where(F.col("size") >= max(least, 2 * per)).withColumn("ref", reference("size", "line")).select("ref", "line", "doc_id", "line_no")
        long = cut(numbered.join(met.select(F.col("a").alias("ref")).union(met.select("b")).distinct(), "ref", "left_semi"))
        wanted = wanted.union(long.select("line"))
    wanted = cut(wanted.distinct())
    seen = lines_among(texts, hit_filter(wanted.select(F.col("line").alias("digest")), bits), least)
    pool = cut(seen.join(wanted, "line", "left_semi").groupBy("line").agg(F.min("text").alias("text")))
    near = only(lambda: near_lines(found, pool, firsts))
    return near if per is None else near.union(only(lambda: near_long_lines(met, long, pool, per))).distinct()


def reference(size: str, line: str):
    """ref_of as a column."""
    return F.shiftleft(F.least(F.col(size), F.lit(MOST_SIZE)).cast("long"), 32).bitwiseOR(F.conv(F.hex(F.substring(line, 1, 4)), 16, 10).cast("long"))


def dropped_lines(documents: DataFrame, least: int = LEAST_CHARS, bits: int = HIT_BITS, per: int | None = None) -> DataFrame:
    """(doc_id, lines): ids of the lines that leave a document. documents: doc_id, text."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    # the segments take the most disk of all, so they come before there is anything else
    met = None if per is None else cut(met_lines(texts, least, per))
    occurring = cut(occurrences(texts, least, per))
    firsts = occurring.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("size").alias("size"), F.count("*").alias("n"))
    firsts = cut(firsts.select("line", "first.doc_id", "first.line_no", "size", "n", (F.col("low") != F.col("high")).alias("repeated")))
    near = only(lambda: near_any(texts, occurring, firsts, met, least, bits, per)).withColumn("near", F.lit(True))
    marked = cut(firsts.join(near, "line", "left").where("repeated or near").select("line", F.col("doc_id").alias("first_doc"), F.coalesce("near", F.lit(False)).alias("near"), "n"))
    drop(firsts, *[] if met is None else [met])
    hot = hot_keys(marked, "line", occurring.count())
    gone = spread_join(occurring.select("line", "doc_id"), marked, "line", hot).where(F.col("near") | (F.col("doc_id") != F.col("first_doc")))
    return gone.groupBy("doc_id").agg(F.collect_list("line").alias("lines"))


def without_repeated_lines(documents: DataFrame, least: int = LEAST_CHARS, bits: int = HIT_BITS, per: int | None = None) -> DataFrame:
    """The documents with the lines that stay, and n_lines and n_dropped; n_chars, where there is one, is that of the new text. Only
    documents that a filter over the ids of those with drops lets through are dealt out by id, if the filter's bound allows one."""
    documents = documents.select(*[c for c in documents.columns if c.lower() not in ("n_lines", "n_dropped")])
    columns = documents.columns
    drop_id, drop_lines, digest = (free_name(n, columns) for n in ("_of", "_lines", "_digest"))
    drops = only(lambda: dropped_lines(documents.select("doc_id", "text"), least, bits, per))
    drops = drops.select(F.col("doc_id").alias(drop_id), F.col("lines").alias(drop_lines))
    digest_of = lambda c: F.unhex(F.md5(F.col(c).cast("long").cast("string").cast("binary")))
    among = hit_filter(drops.select(digest_of(drop_id).alias("digest")), bits)
    may_hold = passing(among, documents.sparkSession)
    at, ids, width = columns.index("text"), columns.index("doc_id"), len(columns)
    names = [*columns, "n_lines", "n_dropped"]

    @F.arrow_udf("boolean")
    def passes(digest: pa.Array) -> pa.Array:
        digests = digest.to_pylist()
        return pa.array(may_hold([d or bytes(16) for d in digests]) & np.array([d is not None for d in digests], dtype=bool))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield stripped(batch, [None] * batch.num_rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield stripped(batch, batch.column(width).to_pylist())

    def stripped(batch: pa.RecordBatch, gone: list) -> pa.RecordBatch:
        texts, counts, drops = [], [], []
        for doc, text, lines in zip(batch.column(ids).to_pylist(), batch.column(at).to_pylist(), gone, strict=True):
            if text is None or doc is None:
                texts.append(text), counts.append(0 if text is None else text.count("\n") + 1), drops.append(0)
                continue
            seen, out, all_lines = set(lines or ()), [], text.split("\n")
            if not seen and len(set(all_lines)) == len(all_lines):
                texts.append(text), counts.append(len(all_lines)), drops.append(0)
                continue
            for line in all_lines:
                if not blank(line):
                    i = line_id(line)
                    if i in seen:
                        continue
                    seen.add(i)
                out.append(line)
            texts.append("\n".join(out)), counts.append(len(all_lines)), drops.append(len(all_lines) - len(out))
        arrays = [pa.array(texts, type=batch.schema.field(at).type) if k == at else batch.column(k) for k in range(width)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(counts, type=pa.int64()), pa.array(drops, type=pa.int64())], names=names)

    schema = documents.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    # ids alone are asked for, the texts stay where they are
    asked = documents if among is None else documents.withColumn(digest, passes(digest_of("doc_id")))
    mine = documents if among is None else asked.where(F.col(digest)).drop(digest)
    out = mine.join(drops, F.col("doc_id").cast("long") == F.col(drop_id), "left").select(*columns, drop_lines).mapInArrow(tidied(joined), schema)
    if among is not None:
        out = out.union(asked.where(~F.col(digest)).drop(digest).mapInArrow(tidied(others), schema))
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in columns else out
