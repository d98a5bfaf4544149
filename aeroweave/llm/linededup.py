"""Line deduplication by a segment-partition edit join.

Two lines are near copies if at most ``EDITS`` single-character edits turn one into the other. A line is cut
into ``EDITS + 1`` segments; of a line within that many edits at least one segment is untouched, so it occurs
in the other line, at most so far displaced as the lengths and the edits left and right of it allow. Each line
is posted under its own segments (with its length), and under the substrings of it that could be a segment of
a line as long or up to ``EDITS`` shorter. Lines that meet under a key are candidates if their character counts
(kept modulo 4 in 31 classes, in one number) differ in at most ``2 * EDITS`` classes, and are verified with a
banded bit-parallel edit distance. Equal lines are one class from the start and stand in the join once.

A key that many lines share never becomes all its pairs. Keys found frequent while lines are read are posted
under five bands of the counts instead: four classes that differ leave one band alike. A list that still is
long gives the pairs with its first member; once these are verified, its members outside the first member's
component are compared with all, in blocks. Pairs inside a component are not needed.

Lines of at least ``LEAST_CHARS`` characters take part in the edit join. Shorter ones, down to ``exact``
characters, are equal or not: their class is the line itself. Blank lines stay. Of each class of near copies the first line, by
doc_id and line number, stays. Rows that agree in doc_id and text count as one document: what stays in one stays
in all. Rows of one doc_id, or of none, with different texts are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, cut, passing, slices, task_caches
from .components import components

EDITS = 2
LEAST_CHARS = 40
LONG_LIST = 128
BLOCK = 512
FREQUENT = 2000
COUNTED_KEYS = 20_000
SEEN_LINES = 300_000
BROADCAST_ROWS = 500_000
FIELDS = 31
BANDS = 5
POWERS = 1 << 20
_PROBE = 1 << 62
_FIELD = np.uint64(1) << (np.uint64(2) * np.arange(FIELDS, dtype=np.uint64))
_LOW = np.uint64(int("01" * FIELDS, 2))
_BAND_BITS = [sum(3 << (2 * f) for f in range(b * 6, FIELDS if b == BANDS - 1 else b * 6 + 6)) for b in range(BANDS)]


def long_lines(text: str | None, least: int = LEAST_CHARS) -> list[tuple[int, str]]:
    """(line number, line without white space at its ends) of the lines that take part."""
    if not text:
        return []
    return [(i, s) for i, line in enumerate(text.split("\n")) if len(line) >= least and len(s := line.strip(" \t\r\x0b\x0c")) >= least]


def line_hashes(lines: list[str]) -> np.ndarray:
    """Two signed words for each line."""
    found = b"".join([xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for line in lines])
    return np.frombuffer(found, ">i8").astype(np.int64).reshape(-1, 2)


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """Begin and end of the segments, whose lengths differ by one at most, shorter ones first."""
    size, longer = divmod(length, edits + 1)
    out, at = [], 0
    for k in range(edits + 1):
        end = at + size + (k >= edits + 1 - longer)
        out.append((at, end))
        at = end
    return out


def windows(length: int, other: int, edits: int = EDITS) -> Iterator[tuple[int, int, int]]:
    """(segment, begin, end) of the substrings of a line of ``length`` that may equal a segment of a line of
    ``other`` <= ``length`` characters: edits before the segment displace it, and so do edits behind it."""
    surplus = length - other
    for k, (a, b) in enumerate(segments(other, edits)):
        low = max(-k, surplus - (edits - k))
        high = min(k, surplus + (edits - k))
        for shift in range(low, high + 1):
            if a + shift >= 0 and b + shift <= length:
                yield k, a + shift, b + shift


def distance(one: str, two: str, most: int) -> int:
    """Edit distance if it is at most ``most``, else ``most + 1``. Bit-parallel over a band of the matrix: bit
    ``k`` of a column's words is the row ``k - most`` below the diagonal."""
    if len(one) < len(two):
        one, two = two, one
    a, b = len(one), len(two)
    if a - b > most:
        return most + 1
    while b and one[a - 1] == two[b - 1]:
        a -= 1
        b -= 1
    start = 0
    while start < b and one[start] == two[start]:
        start += 1
    one, two = one[start:a], two[start:b]
    m, n = len(one), len(two)  # rows: one, columns: two
    if not n:
        return m if m <= most else most + 1
    width = 2 * most + 1
    full = (1 << (width + 1)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(one):
        places[c] = places.get(c, 0) | 1 << i
    # bit k stands for row j - most + k of column j; rows above the matrix are kept out of the band
    up, down = full & ~((1 << most) - 1), 0  # differences of a row to the row above: +1, -1
    score = 0  # value on the diagonal that starts in the corner
    for j in range(1, n + 1):
        seen = places.get(two[j - 1], 0)
        shift = j - 1 - most  # bit 0 of the band is row (j - most), whose character has index j - 1 - most
        match = (seen >> shift if shift >= 0 else seen << -shift) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right = (down | ~(diagonal | up)) & full
        left = diagonal & up
        score += not diagonal >> most & 1
        up = (left | ~((diagonal >> 1) | right)) & full
        down = (diagonal >> 1) & right
    # from row n of the last column down to row m; the band has moved on by one row
    for k in range(m - n):
        score += (up >> (most + k)) & 1
        score -= (down >> (most + k)) & 1
    return score if score <= most else most + 1


_LINES = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("unit", T.LongType()),
    ]
)
_POSTS = T.StructType([T.StructField("key", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("sketch", T.LongType())])
_MET = T.StructType([T.StructField("kind", T.IntegerType()), *_POSTS.fields])
_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


_BASE = 0x9E3779B97F4A7C15
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
    x = x ^ (np.asarray(salt, np.uint64) * _ODD[2])
    x ^= x >> np.uint64(30)
    x *= _ODD[0]
    x ^= x >> np.uint64(27)
    x *= _ODD[1]
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}
task_caches.append(_powers)


def _powers_of(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64; those of ordinary slices are kept."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, POWERS), base, np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if n <= POWERS:
            _powers[base] = found
    return found[:n]


class _Keys:
    """Keys of substrings of many lines at once: differences of running sums of a polynomial modulo 2**64,
    whose odd base has an inverse that makes them the same wherever the substring stands."""

    def __init__(self, lines: list[str], edits: int):
        self.edits = edits
        self.chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.size) - self.size
        self.sums = np.zeros(len(self.chars) + 1, np.uint64)
        np.multiply(self.chars, _powers_of(_BASE, len(self.chars)), out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)
        self.back = _powers_of(pow(_BASE, -1, 1 << 64), len(self.chars) + 1)

    def segment(self, k: int, shorter: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of segment ``k`` of lines ``shorter`` characters shorter, as in ``segments``."""
        parts = self.edits + 1
        size, longer = np.divmod(np.maximum(self.size - shorter, 0), parts)
        begin = k * size + np.maximum(0, k - (parts - longer))
        return begin, begin + size + (k >= parts - longer)

    def key(self, begin: np.ndarray, end: np.ndarray, of: np.ndarray, k: int, shorter: int = 0) -> np.ndarray:
        """Of the substrings of lines ``of``, as segment ``k`` of lines ``shorter`` characters shorter."""
        begin, end = self.start[of] + begin, self.start[of] + end
        found = (self.sums[end] - self.sums[begin]) * self.back[begin]
        return _mixed(found, (self.size[of] - shorter) * 16 + k)

    def own(self) -> list[np.ndarray]:
        every = np.arange(len(self.size))
        return [self.key(*self.segment(k), every, k) for k in range(self.edits + 1)]

    def posts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, line, whether it is not a segment of the line's own) under which the lines are posted."""
        every, own = np.arange(len(self.size)), self.own()
        keys, lines, probes = list(own), [every] * len(own), [np.zeros(len(every), bool)] * len(own)
        for shorter in range(self.edits + 1):
            for k in range(self.edits + 1):
                a, b = self.segment(k, shorter)
                for shift in range(max(-k, shorter - (self.edits - k)), min(k, shorter + (self.edits - k)) + 1):
                    if not shorter and not shift:
                        continue  # its own
                    of = np.flatnonzero((self.size > shorter) & (a + shift >= 0) & (b + shift <= self.size))
                    key = self.key(a[of] + shift, b[of] + shift, of, k, shorter)
                    if not shorter:
                        new = key != own[k][of]
                        key, of = key[new], of[new]
                    keys.append(key)
                    lines.append(of)
                    probes.append(np.ones(len(of), bool))
        return np.concatenate(keys), np.concatenate(lines), np.concatenate(probes)

    def sketches(self) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.size)) * FIELDS, self.size)
        counts = np.bincount(owner + self.chars % FIELDS, minlength=len(self.size) * FIELDS).reshape(-1, FIELDS)
        return ((counts.astype(np.uint64) & np.uint64(3)) * _FIELD).sum(axis=1, dtype=np.uint64)


class _Often:
    """Keys and how often they were met; beyond ``10 * COUNTED_KEYS`` only the most frequent are counted on."""

    def __init__(self):
        self.keys, self.times, self.waiting, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, keys: list[np.ndarray]) -> None:
        self.waiting += keys
        self.n += sum(map(len, keys))
        if self.n > 20 * COUNTED_KEYS:
            self.sum_up()

    def sum_up(self) -> None:
        found, times = np.unique(np.concatenate([*self.waiting, self.keys[:0]]), return_counts=True)
        self.waiting, self.n = [], 0
        if len(self.keys):
            found, place = np.unique(np.concatenate([self.keys, found]), return_inverse=True)
            both = np.zeros(len(found), np.int64)
            np.add.at(both, place, np.concatenate([self.times, times]))
            times = both
        if len(found) > 10 * COUNTED_KEYS:
            most = np.argpartition(times, len(times) - COUNTED_KEYS)[-COUNTED_KEYS:]
            found, times = found[most], times[most]
        self.keys, self.times = found, times


def _read_lines(edits: int, least: int, exact: int):
    """Rows (0, h1, h2, doc_id, line, unit) of lines, and (1, key, count, nulls) of keys that a task met often."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = _Often()
        for part in slices(batches):
            row, number, lines = [], [], []
            for r, text in enumerate(part.column(1).to_pylist()):
                for i, line in long_lines(text, min(least, exact)):
                    row.append(r)
                    number.append(i)
                    lines.append(line)
            if not lines:
                continue
            often.add(_Keys([line for line in lines if len(line) >= least], edits).own())
            names, rows = line_hashes(lines), pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(lines), np.int32)), pa.array(names[:, 0]), pa.array(names[:, 1]), part.column(0).take(rows), pa.array(number, pa.int32()), part.column(2).take(rows)], names=_LINES.names)
        often.sum_up()
        met = often.times >= 8
        if met.any():
            none = pa.nulls(int(met.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(none), np.int32)), pa.array(often.keys[met].view(np.int64)), pa.array(often.times[met]), none, none.cast(pa.int32()), none], names=_LINES.names)

    return work


def _post(edits: int, least: int, frequent: np.ndarray):
    """``frequent``: sorted keys that are posted in bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posted: set[int] = set()
        for part in slices(batches):
            lines = [line for text in part.column(0).to_pylist() for _, line in long_lines(text, least)]
            names, new = line_hashes(lines)[:, 0], []
            for k, h in enumerate(names.tolist()):
                if h not in posted:
                    posted.add(h)
                    new.append(k)
            if len(posted) > SEEN_LINES:
                posted.clear()
            if not new:
                continue
            text = _Keys([lines[k] for k in new], edits)
            key, of, probe = text.posts()
            names, sketch = names[new][of], text.sketches()[of]
            mark = sketch | np.where(probe, np.uint64(_PROBE), np.uint64(0))
            if len(frequent):
                banded = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
                if banded.any():
                    bands = [_mixed(_mixed(key[banded], b + 1) ^ (sketch[banded] & np.uint64(bits))) for b, bits in enumerate(_BAND_BITS)]
                    key = np.concatenate([key[~banded], *bands])
                    names, mark = (np.concatenate([x[~banded], *[x[banded]] * BANDS]) for x in (names, mark))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(names), pa.array(mark.view(np.int64))], names=_POSTS.names)

    return work


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many classes two sketches differ."""
    x = (a ^ b).view(np.uint64)
    return np.bitwise_count((x | x >> np.uint64(1)) & _LOW)


def _meet(edits: int):
    """Posts sorted by key: rows (0, 0, a, b) of candidate pairs; rows (1, key, h1, sketch) of long lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        long_key = None

        def rows(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c)], names=_MET.names)

        def whole(key: np.ndarray, h1: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)
            busy = sizes[group] > 1
            if not busy.any():
                return
            key, h1, sketch = key[busy], h1[busy], sketch[busy]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            left, right = [starts[sizes == 2]], [starts[sizes == 2] + 1]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if n > LONG_LIST:
                    yield rows(1, key[s : s + n], h1[s : s + n], sketch[s : s + n])
                    continue
                i, j = np.triu_indices(n, 1)
                left.append(s + i)
                right.append(s + j)
            i, j = np.concatenate(left), np.concatenate(right)
            # one of the two must be posted there with a segment of its own
            good = (h1[i] != h1[j]) & ((sketch[i] & sketch[j] & _PROBE) == 0)
            i, j = i[good], j[good]
            close = _unlike(sketch[i] & (_PROBE - 1), sketch[j] & (_PROBE - 1)) <= 2 * edits
            i, j = i[close], j[close]
            if len(i):
                pairs = np.unique(np.stack([np.minimum(h1[i], h1[j]), np.maximum(h1[i], h1[j])], axis=1), axis=0)
                yield rows(0, np.zeros(len(pairs), np.int64), pairs[:, 0].copy(), pairs[:, 1].copy())

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            last = now[0][-1]
            cut_at = int(np.flatnonzero(now[0] != last)[-1]) + 1 if (now[0] != last).any() else 0
            if cut_at:
                if long_key is not None:  # the rest of a list that was too long to hold
                    rest = int(np.searchsorted((now[0] != long_key).astype(np.int8), 1)) if now[0][0] == long_key else 0
                    if rest:
                        yield rows(1, *(c[:rest] for c in now))
                    long_key = None
                    yield from whole(*(c[rest:cut_at] for c in now))
                else:
                    yield from whole(*(c[:cut_at] for c in now))
            held = [c[cut_at:] for c in now]
            if len(held[0]) > 100_000:
                long_key = int(held[0][0])
                yield rows(1, *held)
                held = [c[:0] for c in held]
        if long_key is not None and len(held[0]) and held[0][0] == long_key:
            yield rows(1, *held)
        else:
            yield from whole(*held)

    return work


_TEXTS = T.StructType([T.StructField("h1", T.LongType()), T.StructField("content", T.StringType())])


def _wanted_lines(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h1, out = [], []
            for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                wanted = set(wanted)
                lines = [line for _, line in long_lines(text, least)]
                for line, h in zip(lines, line_hashes(lines)[:, 0].tolist(), strict=True):
                    if h in wanted:
                        wanted.discard(h)
                        h1.append(h)
                        out.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(out, pa.string())], names=_TEXTS.names)

    return work


def _verify(edits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=4096):
            a, b, p, q = (c.to_pylist() for c in part.columns)
            good = [k for k in range(len(a)) if distance(p[k], q[k], edits) <= edits]
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good]), pa.array([b[k] for k in good])], names=_PAIRS.names)

    return work


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a written table only if it has few rows; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unit_key(text: Column) -> Column:
    """With the doc_id: whose line it is."""
    return F.xxhash64(text)


class LineJoin:
    def __init__(self, docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, exact: int = LEAST_CHARS):
        self.edits, self.least = edits, least
        self.docs = columns(docs, doc_id=T.LongType(), text=T.StringType()).withColumn("unit", unit_key(F.col("text")))
        read = cut(self.docs.mapInArrow(_read_lines(edits, least, exact), _LINES), "lines")
        self.lines = read.where("kind = 0").drop("kind")
        often = read.where("kind = 1").groupBy("h1").agg(F.sum("h2").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.col("n").desc()).limit(COUNTED_KEYS)
        self.frequent = np.sort(np.array([r["h1"] for r in often.collect()], np.int64).view(np.uint64))  # at most COUNTED_KEYS numbers
        order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "line", "unit")
        self.firsts = cut(self.lines.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("times")), "line-classes")

    def candidates(self) -> DataFrame:
        posts = self.docs.select("text").mapInArrow(_post(self.edits, self.least, self.frequent), _POSTS)
        return cut(posts.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(self.edits), _MET), "met")

    def verified(self, pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.distinct(), "line-pairs")
        ends = pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct()
        places = self.firsts.join(ends, "h1").select("h1", F.col("first.doc_id").alias("place"), F.col("first.unit").alias("whose"))
        wanted = cut(places.groupBy("place", "whose").agg(F.collect_set("h1").alias("wanted")), "wanted-lines")  # lines of one document
        found = self.docs.join(_small(wanted), self.docs["doc_id"].eqNullSafe(wanted["place"]) & (self.docs["unit"] == wanted["whose"])).select("text", "wanted")
        texts = cut(found.mapInArrow(_wanted_lines(self.least), _TEXTS).distinct(), "line-texts")
        left = pairs.join(texts.select(F.col("h1").alias("a"), F.col("content").alias("p")), "a")
        both = left.join(texts.select(F.col("h1").alias("b"), F.col("content").alias("q")), "b").select("a", "b", "p", "q")
        return cut(both.mapInArrow(_verify(self.edits), _PAIRS).distinct(), "line-links")

    def _close(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, x), (b, y) of lines and sketches that differ in few enough classes."""
        diff = F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit(_PROBE - 1))
        spread = F.bit_count(diff.bitwiseOR(F.shiftright(diff, 1)).bitwiseAND(F.lit(int(_LOW))))
        return rows.where((F.col("a") != F.col("b")) & (spread <= 2 * self.edits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(verified links, components of linked lines)."""
        met = self.candidates()
        pairs = met.where("kind = 0").select(F.col("h1").alias("a"), F.col("sketch").alias("b"))
        lists = met.where("kind = 1").select("key", "h1", "sketch").distinct()
        if not lists.take(1):
            links = self.verified(pairs)
            return links, cut(components(links), "line-components")
        lists = cut(lists, "long-lists")
        heads = cut(lists.groupBy("key").agg(F.min(F.struct("h1", "sketch")).alias("head"), F.count("*").alias("size")), "heads")
        stars = lists.join(heads, "key").select(F.col("head.h1").alias("a"), F.col("head.sketch").alias("x"), F.col("h1").alias("b"), F.col("sketch").alias("y"))
        links = self.verified(pairs.unionByName(self._close(stars)))
        comps = cut(components(links), "line-components")
        rest = self._outside(lists, heads, comps)
        extra = self.verified(rest.join(links, ["a", "b"], "left_anti"))
        if extra.take(1):
            links = links.unionByName(extra)
            comps = cut(components(links), "line-components")
        return links, comps

    def _outside(self, lists: DataFrame, heads: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs of a long list's members outside its head's component with all its members, in blocks."""
        of = comps.select(F.col("id").alias("h1"), "component")
        head = heads.select("key", "size", F.col("head.h1").alias("h1")).join(of, "h1", "left").select("key", "size", F.coalesce("component", "h1").alias("main"))
        named = lists.join(of, "h1", "left").select("key", "h1", "sketch", F.coalesce("component", "h1").alias("comp"))
        rows = cut(named.join(cut(head, "mains"), "key").withColumn("chunk", F.pmod(F.xxhash64("h1"), F.ceil(F.col("size") / BLOCK)).cast("int")), "long-rows")
        ask = rows.where("comp != main").withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / BLOCK) - 1).cast("int"))))
        ask = ask.select("key", "chunk", F.col("h1").alias("a"), F.col("sketch").alias("x"), F.col("comp").alias("one"))
        met = ask.join(rows.select("key", "chunk", F.col("h1").alias("b"), F.col("sketch").alias("y"), F.col("comp").alias("two")), ["key", "chunk"])
        return self._close(met.where("one != two")).distinct()

    def decisions(self) -> DataFrame:
        """doc_id, unit, line, keep, class_doc for every line that has a copy or a near copy; others stay."""
        _, comps = self.links()
        named = self.firsts.join(comps.withColumnRenamed("id", "h1"), "h1", "left").where((F.col("times") > 1) | F.col("component").isNotNull())
        named = cut(named.select("h1", "h2", "first", F.coalesce("component", "h1").alias("class")), "line-names")
        least = cut(named.groupBy("class").agg(F.min("first").alias("top")), "class-firsts")
        by_line = cut(named.join(least, "class").select("h1", "h2", "top"), "line-tops")
        rows = self.lines.join(_small(by_line), ["h1", "h2"])
        keep = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("line") == F.col("top.line")) & (F.col("unit") == F.col("top.unit"))
        return rows.select("doc_id", "unit", "line", keep.alias("keep"), F.col("top.doc_id").alias("class_doc"))


_CLEAN = [T.StructField("clean", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]


def deduplicated(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, exact: int = LEAST_CHARS) -> DataFrame:
    """All columns of ``docs``, and: clean (the text without its removed lines; null stays null), n_lines,
    n_removed, copies_of (sorted doc_ids in which the removed lines stay).

    Empty texts have one line, null texts none. A line of fewer than ``least`` characters
    goes only as an exact repeat, one of fewer than ``exact`` and ``least`` never; with 1 all lines but blank ones take part. Repeated rows
    are alike. Columns of the same names as the added ones are replaced. An empty table gives no rows.
    """
    with passing(docs.sparkSession):
        gone = LineJoin(docs, edits, least, exact).decisions().where("not keep")
        gone = gone.groupBy(F.col("doc_id").alias("__gone"), F.col("unit").alias("__unit")).agg(F.array_sort(F.collect_set("line")).alias("__lines"), F.array_sort(F.collect_set("class_doc")).alias("copies_of"))
        gone = cut(gone, "removed-lines", keep=True)  # per document: its own lines
    names = [n for n in docs.columns if n.lower() not in ("clean", "n_lines", "n_removed", "copies_of")]
    own = {n.lower(): n for n in docs.columns}
    key = F.col(f"`{own['doc_id']}`").cast("long") if "doc_id" in own else F.lit(None).cast("long")
    text = F.col(f"`{own['text']}`").cast("string") if "text" in own else F.lit(None).cast("string")
    joined = docs.join(_small(gone), key.eqNullSafe(F.col("__gone")) & (unit_key(text) == F.col("__unit")), "left")
    # line numbers are positions in the split text
    split = F.split(text, "\n")
    lines = F.coalesce("__lines", F.array().cast("array<int>"))
    clean = F.when(F.size(lines) == 0, text).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains(lines, i)), "\n"))
    return joined.select(
        *[F.col(f"`{n}`") for n in names],
        clean.alias("clean"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.size(lines).cast("long").alias("n_removed"),
        F.coalesce("copies_of", F.array().cast("array<bigint>")).alias("copies_of"),
    )


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, copies_of, n_chars and crc32 of the text that stays."""
    clean = F.coalesce("clean", F.lit(""))
    rows = deduplicated(columns(docs, doc_id=T.LongType(), text=T.StringType()), exact=1)
    return rows.select("doc_id", "n_lines", "n_removed", "copies_of", F.length(clean).cast("long").alias("n_chars"), F.crc32(clean.cast("binary")).alias("text_crc32"))
