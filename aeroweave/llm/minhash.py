"""Near-duplicate detection by an inverted join over signature coordinates, confirmed on full shingle sets.

Each distinct shingle set (a class of copies) has a signature of ``COORDS`` minimum hashes, and stands in a list
for each (coordinate, value) pair. Two classes are candidates if they collide in ``MATCHES`` lists or more, which
two sets of similarity 0.75 miss with probability 5e-6. Collisions are counted with prefix and skip merging: a
class's lists are ordered by length, those where it is alone count for nothing, and a class with fewer than
``MATCHES`` others collides with nobody often enough. Of the rest the ``MATCHES - 1`` longest are skipped: a
candidate must also meet in one of the others, the prefix, which alone are merged. Whether the members of a merged
list also meet in the skipped ones is looked up in their signatures. A passage that many documents share fills the
longest lists, which are the ones that nobody merges.

A merged list never becomes all its pairs. A short one gives a spanning forest of its likely pairs, a long one the
pairs with its head, the member whose lists are the longest and so the nearest to what most members agree on.
These pairs are confirmed on full sets. Lists of members that are now of one component are done. Of the others,
short ones give their pairs across components, and the members of long ones are listed once more, under the
rarest quarter of their full sets: sets of similarity 0.75 share one of these shingles for certain. Such lists
are treated the same way; a long one that still has several components is compared in blocks, on full sets, the
members outside the head's component against all. Pairs inside one component are never needed, so no link between
components is lost.

Classes are told apart by a 64-bit hash of the whole set and shingles by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, columns, cut, passing, slices, small, task_caches
from .components import components

SHINGLE = 5
COORDS = 64
MATCHES = 32
LIKELY = 44
LONG_LIST = 128
BLOCK = 2048
SHARE = 512
PERCENT = 75
CACHE_WORDS = 300_000

_rng = np.random.default_rng(20240901)
_MULTIPLIERS = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITIONS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()
task_caches.append(_words)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of the whole sequence if there are fewer words."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    if n < 1:
        total, count = np.zeros(1, np.uint64), len(h)
        for i in range(count):
            total += h[i : i + 1] * _POSITIONS[i]
        return _mix(total + np.uint64(count))
    total = h[:n] * _POSITIONS[0]
    for i in range(1, SHINGLE):
        total += h[i : i + n] * _POSITIONS[i]
    return np.unique(_mix(total))


def class_of(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(found.tobytes())], np.uint64).view(np.int64)[0])


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(least, (_MULTIPLIERS[:, None] * found[None, i : i + 512]).min(axis=1), out=least)
    return least


_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("unit", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("cls", T.LongType()),
        T.StructField("sig", T.BinaryType()),
        T.StructField("posts", T.ArrayType(T.LongType())),
    ]
)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        n, cls, sigs, posts = [], [], [], []
        for text in as_bytes(part.column(1)):
            found = shingles(text)
            n.append(len(found))
            if len(found):
                least = signature(found)
                cls.append(class_of(found))
                sigs.append((least >> np.uint64(48)).astype("<u2").tobytes())
                posts.append(_mix(least ^ _SALTS).view(np.int64).tolist())
            else:
                cls.append(None)
                sigs.append(None)
                posts.append(None)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sigs, pa.binary()), pa.array(posts, pa.list_(pa.int64()))], names=_SIGNED.names
        )


_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by their first column, regrouped so that no list spans two items."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = rows.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], "left")) if key[0] <= key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
        if last:
            yield _arrays(rows.slice(0, last))
        held = rows.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield _arrays(held)


def _arrays(rows: pa.Table) -> tuple[np.ndarray | list[bytes], ...]:
    out = []
    for name, c in zip(rows.column_names, rows.columns, strict=True):
        if name == "sig":
            out.append(np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, COORDS))
        else:
            out.append(c.to_pylist() if pa.types.is_binary(c.type) or pa.types.is_list(c.type) else c.to_numpy())
    return tuple(out)


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if a:
        x, y = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=_PAIRS.names)


def _close(n: np.ndarray, i, j) -> np.ndarray:
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return 100 * small >= PERCENT * large


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns token, cls, n, sig: a spanning forest of each list's likely pairs."""
    for token, cls, n, sig in _lists(batches):
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        sizes = np.diff(np.r_[starts, len(token)])
        two = starts[sizes == 2]
        a, b = [], []
        for k in range(0, len(two), 65536):
            i = two[k : k + 65536]
            good = i[((sig[i] == sig[i + 1]).sum(axis=1) >= MATCHES) & _close(n, i, i + 1)]
            a.append(cls[good])
            b.append(cls[good + 1])
        for s, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            left = np.arange(s, s + size)
            queue: list[int] = []
            while len(left):
                if not queue:
                    queue, left = [left[0]], left[1:]
                    continue
                u = queue.pop()
                like = ((sig[left] == sig[u]).sum(axis=1) >= LIKELY) & _close(n, left, u)
                if like.any():
                    found = left[like]
                    a.append(np.full(len(found), cls[u]))
                    b.append(cls[found])
                    queue.extend(found.tolist())
                    left = left[~like]
        yield from _pair_batch(a, b)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns token, cls, n, sig, comp, own: each list's pairs across components with enough matches. A pair is
    given by the first list of both alone, which ``own`` tells, the tokens of a class's lists; null: by each."""
    for token, cls, n, sig, comp, own in _lists(batches):
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        a, b = [], []
        for s, size in zip(starts, np.diff(np.r_[starts, len(token)]), strict=True):
            before = [{t for t in o or () if t < token[s]} for o in own[s : s + size]]
            for i in range(s, s + size - 1):
                rest = np.arange(i + 1, s + size)
                rest = rest[comp[rest] != comp[i]]
                if len(rest):
                    rest = rest[((sig[rest] == sig[i]).sum(axis=1) >= MATCHES) & _close(n, rest, i)]
                    rest = np.array([k for k in rest.tolist() if before[i - s].isdisjoint(before[k - s])], np.int64)
                    a.append(np.full(len(rest), cls[i]))
                    b.append(cls[rest])
        yield from _pair_batch(a, b)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b, m, n, p, sig: the pairs whose sizes allow a link and whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, COORDS) for k in (4, 5))
            m, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            good = (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n)) & ((p == q).sum(axis=1) >= MATCHES)
            yield from _pair_batch([batch.column(0).to_numpy()[good]], [batch.column(1).to_numpy()[good]])


_LINKS = T.StructType([*_PAIRS.fields, T.StructField("shared", T.LongType())])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, rows=1024, size=8 << 20):
        a, b, shared = [], [], []
        for x, y, p, q in zip(*(c.to_pylist() for c in part.columns), strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(p) + len(q) - len(np.union1d(p, q))
            if 100 * both >= PERCENT * (len(p) + len(q) - both):
                a.append(x)
                b.append(y)
                shared.append(both)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared)], names=_LINKS.names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns block, cls, comp, outside, found: links of an outside row with any row that join two components
    not yet joined in the block.

    The rows' sets are one inverted index; an outside row's intersections with all of them are one count.
    """
    for token, cls, comp, outside, found in _lists(batches):
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        a, b, shared = [], [], []
        for s, size in zip(starts.tolist(), np.diff(np.r_[starts, len(token)]).tolist(), strict=True):
            every = np.flatnonzero(outside[s : s + size] == 0) + s
            ask = np.flatnonzero(outside[s : s + size] == 1) + s
            if not len(every) or not len(ask):
                continue
            sets = [np.frombuffer(found[k], np.uint64) for k in every]
            sizes = np.array([len(x) for x in sets])
            values, place = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(every)), sizes)
            mark = np.zeros(len(values) + 1, bool)
            above: dict[int, int] = {}

            def root(c: int) -> int:
                while c in above:
                    c = above[c]
                return c

            for i in ask:
                own = np.frombuffer(found[i], np.uint64)
                at = np.searchsorted(values, own)
                at = at[values[np.minimum(at, len(values) - 1)] == own]
                mark[at] = True
                both = np.bincount(owner[mark[place]], minlength=len(every))
                mark[at] = False
                good = np.flatnonzero((100 * both >= PERCENT * (len(own) + sizes - both)) & (comp[every] != comp[i]))
                if len(good):
                    _, one = np.unique(comp[every[good]], return_index=True)
                    for k in good[one].tolist():
                        x, y = root(int(comp[i])), root(int(comp[every[k]]))
                        if x != y:
                            above[max(x, y)] = min(x, y)
                            a.append(cls[i])
                            b.append(cls[every[k]])
                            shared.append(both[k])
        if a:
            x, y = np.array(a), np.array(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.array(shared, np.int64))], names=_LINKS.names)


_SETS = T.StructType([T.StructField("cls", T.LongType()), T.StructField("found", T.BinaryType())])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        cls, sets = [], []
        for wanted, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
            found = shingles(text)
            if len(found) and class_of(found) == wanted:  # another row may have the same doc_id
                cls.append(wanted)
                sets.append(found.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=_SETS.names)


_SHINGLES = T.StructType([T.StructField("cls", T.LongType()), T.StructField("token", T.LongType()), T.StructField("n", T.LongType())])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns cls, found: a row for each shingle of the sets, with the set's size."""
    for part in slices(batches, rows=1024, size=1 << 20):
        sets = [np.frombuffer(f, np.int64) for f in part.column(1).to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        cls = np.repeat(part.column(0).to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.concatenate(sets)), pa.array(np.repeat(sizes, sizes))], names=_SHINGLES.names)


def _by_list(rows: DataFrame, key: str, work: Callable, shape: T.StructType) -> DataFrame:
    return rows.repartition(F.col(key)).sortWithinPartitions(key, "cls").mapInArrow(work, shape)


def _prefixes(rows: DataFrame, key: str, least: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row (cls, weight, key) for each list to merge. ``rows``: cls, key and per class ``extra``; ``least``: in
    how many lists two classes must meet. Lists of one member are no lists; of a class's others, by length, all
    but the ``least - 1`` longest are merged. ``weight``: the lengths of the class's lists, summed up."""
    sizes = cut(rows.groupBy(key).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = rows.join(sizes, key).groupBy("cls", *extra)
    own = shared.agg(F.array_sort(F.collect_list(F.struct("size", key))).alias("own"), F.sum("size").alias("weight")).where(F.size("own") >= least)
    merged = F.expr("slice(own, 1, cast(size(own) - needed + 1 as int))")
    rows = own.withColumn("needed", least).withColumn("own", merged).select("cls", *extra, "weight", F.explode("own").alias("one"))
    return cut(rows.select("cls", *extra, "weight", F.col(f"one.{key}").alias(key)), "prefixes")


class Join:
    """The steps of the join over one table of documents."""

    def __init__(self, docs: DataFrame):
        self.docs = columns(docs, doc_id=T.LongType(), text=T.StringType()).withColumn("unit", unit_key(F.col("text")))
        self.signed = cut(self.docs.mapInArrow(_sign, _SIGNED), "signed")
        some = self.signed.where("cls is not null").groupBy("cls")
        # of the rows of a class the first one by doc_id stands for all; rows of one doc_id are told apart by their texts
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "unit"))
        classes = some.agg(first.alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("posts").alias("posts"))
        self.classes = cut(classes, "classes")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(cls, found): the full sets of the classes in column cls of ``wanted``; a written table."""
        ends = cut(self.classes.select("cls", F.col("rep.doc_id").alias("rep"), F.col("rep.unit").alias("whose")).join(wanted.select("cls").distinct(), "cls"), "wanted")
        texts = self.docs.join(small(ends), self.docs["doc_id"].eqNullSafe(ends["rep"]) & (self.docs["unit"] == ends["whose"])).select("cls", "text")
        return cut(texts.mapInArrow(_full_sets, _SETS).dropDuplicates(["cls"]), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b, shared) among the pairs, on full sets."""
        pairs = cut(pairs.distinct(), "pairs")
        sets = self.sets(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))))
        left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("found").alias("p")), "a")
        full = left.join(sets.select(F.col("cls").alias("b"), F.col("found").alias("q")), "b")
        return cut(full.select("a", "b", "p", "q").mapInArrow(_confirm, _LINKS), "links")

    def merged_lists(self) -> DataFrame:
        """token, size, head, cls: the members of the lists to merge; a written table."""
        rows = _prefixes(self.classes.select("cls", F.explode("posts").alias("token")), "token", F.lit(MATCHES))
        lists = cut(rows.groupBy("token").agg(F.count("*").alias("size"), F.max(F.struct("weight", "cls")).alias("head")).where("size > 1"), "lists")
        return cut(rows.join(lists, "token").select("token", "size", F.col("head.cls").alias("head"), "cls"), "members")

    def listed(self, rows: DataFrame, *extra: str) -> DataFrame:
        """The members of lists with n, sig and ``own``, all tokens of the class; a class meets its signature once."""
        own = rows.groupBy("cls", *extra).agg(F.sort_array(F.collect_list("token")).alias("own"))
        return own.join(self.classes.select("cls", "n", "sig"), "cls").select(F.explode("own").alias("token"), "cls", "n", "sig", *extra, "own")

    def stars(self, members: DataFrame) -> DataFrame:
        """Candidate pairs of heads with members; columns head, cls."""
        rows = members.where(F.col("cls") != F.col("head")).select("head", "cls").distinct().join(self.classes.select("cls", "n", "sig"), "cls")
        head = self.classes.select(F.col("cls").alias("head"), F.col("n").alias("m"), F.col("sig").alias("p"))
        return rows.join(head, "head").select(F.col("head").alias("a"), F.col("cls").alias("b"), "m", "n", "p", "sig").mapInArrow(_compare, _PAIRS)

    def first_round(self, members: DataFrame) -> DataFrame:
        """Candidate pairs: spanning forests of short lists, stars of long ones."""
        short = self.listed(members.where(F.col("size") <= LONG_LIST))
        forests = _by_list(short.select("token", "cls", "n", "sig"), "token", _forest, _PAIRS)
        return forests.unionByName(self.stars(members.where(F.col("size") > LONG_LIST)))

    def mixed(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """The members, with comp, of the lists that have several components; a written table."""
        named = members.join(comps.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
        named = cut(named, "named")
        lists = named.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("token")
        return cut(named.join(lists, "token"), "mixed")

    def across(self, rows: DataFrame, once: bool = True) -> DataFrame:
        """Candidate pairs across components in short lists; ``once``: each by one list only, for which every
        member carries all tokens of its class, so there must be few."""
        own = F.col("own") if once else F.lit(None).cast("array<bigint>")
        return _by_list(self.listed(rows, "comp").select("token", "cls", "n", "sig", "comp", own.alias("own")), "token", _across, _PAIRS)

    def rare_lists(self, rows: DataFrame) -> DataFrame:
        """token, size, head, cls: the classes in column cls, listed under the rarest quarter of their sets."""
        sets = self.sets(rows)
        every = sets.mapInArrow(_shingle_rows, _SHINGLES)
        # of two sets linked, the union holds the larger one: they share PERCENT of its size or more
        rows = _prefixes(every, "token", F.expr(f"({PERCENT} * n + 99) div 100"), ("n",))
        lists = cut(rows.groupBy("token").agg(F.count("*").alias("size"), F.max(F.struct("weight", "cls")).alias("head")).where("size > 1"), "rare-lists")
        return cut(rows.join(lists, "token").select("token", "size", F.col("head.cls").alias("head"), "cls"), "rare-members")

    def _in_blocks(self, rows: DataFrame) -> DataFrame:
        """Links, on full sets, of the members of lists outside their head's component with any member.

        The exact way for what is left: each member is sent once for every ``SHARE`` outside members of its list.
        """
        main = F.max(F.when(F.col("cls") == F.col("head"), F.col("comp"))).alias("main")
        lists = cut(rows.groupBy("token").agg(main), "mains")
        rows = rows.join(lists, "token").withColumn("outside", (F.col("comp") != F.col("main")).cast("int"))
        rows = cut(rows, "block-members")
        rows = rows.join(cut(rows.where("outside = 1").groupBy("token").agg(F.count("*").alias("out")), "outside"), "token")
        rows = rows.withColumn("chunks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("shares", F.ceil(F.col("out") / SHARE).cast("int"))
        rows = cut(rows.select("token", "cls", "comp", "outside", "chunks", "shares"), "block-rows")
        chunk = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
        share = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("shares")).cast("int")
        block = F.xxhash64("token", "chunk", "share").alias("block")
        # each row stands once in each share of the outside rows; each outside row once in each chunk of all rows
        every = rows.withColumn("chunk", chunk).withColumn("share", F.explode(F.expr("sequence(0, shares - 1)"))).select(block, "cls", "comp", F.lit(0).alias("outside"))
        those = rows.where("outside = 1").withColumn("share", share).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).select(block, "cls", "comp", F.lit(1).alias("outside"))
        both = every.unionByName(those).join(self.sets(rows), "cls")
        return cut(_by_list(both.select("block", "cls", "comp", "outside", "found"), "block", _blocks, _LINKS), "block-links")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(confirmed links that connect every component, components of classes with a link)."""
        members = self.merged_lists()
        links = self.confirmed(self.first_round(members))
        comps = cut(components(links), "components")

        def add(more: DataFrame) -> bool:
            nonlocal links, comps
            if not more.take(1):
                return False
            links = links.unionByName(more)
            comps = cut(components(links), "components")
            return True

        rows = self.mixed(members, comps)
        long = rows.where(F.col("size") > LONG_LIST)
        pairs = self.across(rows.where(F.col("size") <= LONG_LIST))
        if not long.take(1):
            add(self.confirmed(pairs))
            return links, comps
        rare = self.mixed(self.rare_lists(long), comps)
        pairs = pairs.unionByName(self.across(rare.where(F.col("size") <= LONG_LIST), once=False))
        pairs = pairs.unionByName(self.stars(rare.where(F.col("size") > LONG_LIST)))
        add(self.confirmed(pairs.distinct().join(links.select("a", "b"), ["a", "b"], "left_anti")))
        left = self.mixed(rare.where(F.col("size") > LONG_LIST).drop("comp"), comps)
        if left.take(1):
            add(self._in_blocks(left))
        return links, comps


def unit_key(text: Column) -> Column:
    """With the doc_id: which document it is."""
    return F.xxhash64(text)


def _named(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, unit, n, cls, and ``top``, the first row (none, doc_id, unit) of its component; null for
    rows without words."""
    join = Join(docs)
    _, comps = join.links()
    named = join.classes.select("cls", "rep").join(comps.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    named = cut(named, "named-classes")
    least = named.groupBy("component").agg(F.min("rep").alias("top"))
    by_class = cut(named.join(cut(least, "least-ids"), "component").select("cls", "top"), "class-ids")
    return join.signed.select("doc_id", "unit", "n", "cls").join(by_class, "cls", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that links reach, the document itself included; documents without
    words (null, empty, only white space) reach themselves alone. Exact copies are one class and stand in the
    join once. Rows with a null doc_id count, and take the smallest id of their component, or null. Rows of one
    doc_id with different texts are documents of their own. Repeated rows each get a row. Extra columns are
    ignored. An empty table gives no rows.
    """
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id"))
    rows = _named(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component, by doc_id (null last); a repeated
    row once. Rows without words, a missing column text included, are linked with nothing and all stay."""
    with passing(docs.sparkSession):
        named = _named(docs).where("cls is not null")
        mine = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("unit") == F.col("top.unit"))
        kept = named.where(mine).groupBy(F.col("doc_id").alias("__id"), F.col("unit").alias("__unit")).agg(F.count("*").alias("__times"))
        kept = cut(kept, "kept", keep=True)
    own = {c.lower(): c for c in docs.columns}
    key, text = (F.col(f"`{own[c]}`").cast(t) if c in own else F.lit(None).cast(t) for c, t in (("doc_id", "long"), ("text", "string")))
    rows = docs.join(small(kept), key.eqNullSafe(F.col("__id")) & (unit_key(text) == F.col("__unit")), "left")
    rows = rows.where(F.col("__times").isNotNull() | ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    once = rows.where(F.coalesce("__times", F.lit(1)) == 1)
    if kept.where(F.col("__times") > 1).take(1):
        several = rows.where(F.col("__times") > 1).dropDuplicates(["__id", "__unit"])
        once = once.unionByName(several)
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
