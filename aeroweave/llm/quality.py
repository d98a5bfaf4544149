"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of binned statistics with monotonic constraints on chosen ones, then flattened
into numpy node arrays, so that scoring steps all documents of a batch through all trees at once. The model
learns from a bounded sample of labelled rows (``TRAIN_ROWS``); the statistics of every document come from
its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, columns, slices, task_caches

TRAIN_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5
TREES, DEPTH, BINS, RATE, LEAF_WEIGHT, RIDGE = 60, 3, 64, 0.2, 5.0, 1.0
CACHE_WORDS = 300_000

#: Statistics in model order; -1: the quality may only fall as the statistic rises, +1: only rise, 0: free.
FEATURES = (
    ("log_words", 0),
    ("word_length", 0),
    ("symbol_share", -1),
    ("dup_line_share", -1),
    ("repeat_share", -1),
    ("upper_share", 0),
    ("digit_share", 0),
    ("punct_share", 0),
    ("distinct_share", 0),
    ("line_words", 0),
    ("shout_share", -1),
)

# White space between words, and the symbols that are counted.
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*_SPACE]] = 1
_CLASS[[*_SYMBOLS]] = 2
_CLASS[[*range(65, 91)]] = 3
_CLASS[[*range(48, 58)]] = 4
_CLASS[[*b".,;:!?'\"()-"]] = 5
_CLASS[33] = 6
_CLASS[128:192] = 7  # further bytes of a character


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()
task_caches.append(_words)


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], the model's statistics)."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    chars = len(text) - int(kinds[1]) - int(kinds[7])
    symbols = int(kinds[2])
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    if len(_words) > CACHE_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    distinct, repeated = len(np.unique(h)), 0
    if n >= 3:
        w = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        order = np.argsort(w)
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + n - 2] |= twice
            repeated = int(covered.sum())
    features = [
        float(np.log1p(n)),
        chars / n,
        symbols / chars,
        dup_lines / max(1, len(lines)),
        repeated / n,
        int(kinds[3]) / chars,
        int(kinds[4]) / chars,
        int(kinds[5]) / chars,
        distinct / n,
        n / max(1, len(lines)),
        int(kinds[6]) / n,
    ]
    return [n, chars, symbols, dup_lines, repeated], features


@dataclass
class Forest:
    """All trees in flat arrays: node i of a tree goes to ``left[i]`` if its statistic is at most the threshold,
    else to ``left[i] + 1``; a leaf goes to itself (statistic 0, threshold infinite)."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        line = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = self.left[at] + (x[line, self.feature[at]] > self.threshold[at])
        return self.start + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...] = tuple(s for _, s in FEATURES), trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosting for the log loss. With one class or no rows the forest is a constant."""
    rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
    start = float(np.log(rate / (1 - rate)))
    feature, threshold, left, value, roots = [0], [np.inf], [0], [0.0], [0]
    if len(y) < 20 or y.min() == y.max():
        return Forest(start, np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), 1)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), start)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        value.append(0.0)
        return len(left) - 1

    def weight(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + RIDGE), low), high)

    def gain(g, h, w):
        return -(g * w + 0.5 * (h + RIDGE) * w * w)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        todo = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            at, rows, low, high, level = todo.pop()
            total_g, total_h = float(g[rows].sum()), float(h[rows].sum())
            own = weight(total_g, total_h, low, high)
            best, split = gain(total_g, total_h, own) + 1e-6, None
            for j, sign in enumerate(signs if level < depth else ()):
                size = len(cuts[j]) + 1
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], size))[:-1]
                gr, hr = total_g - gl, total_h - hl
                wl, wr = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-gr / (hr + RIDGE), low, high)
                found = gain(gl, hl, wl) + gain(gr, hr, wr)
                found[(hl * 4 < LEAF_WEIGHT) | (hr * 4 < LEAF_WEIGHT) | (sign * (wr - wl) < 0)] = -np.inf
                if len(found) and found.max() > best:
                    k = int(found.argmax())
                    best, split = float(found[k]), (j, k, float(wl[k]), float(wr[k]))
            if split is None:
                value[at] = RATE * own
                margin[rows] += RATE * own
                continue
            j, k, wl, wr = split
            feature[at], threshold[at] = j, float(cuts[j][k])
            left[at] = node()
            node()
            go = binned[rows, j] <= k
            middle = (wl + wr) / 2
            bounds = [(low, high), (low, high)]
            if signs[j] > 0:
                bounds = [(low, middle), (middle, high)]
            elif signs[j] < 0:
                bounds = [(middle, high), (low, middle)]
            todo.append((left[at], rows[go], *bounds[0], level + 1))
            todo.append((left[at] + 1, rows[~go], *bounds[1], level + 1))
    return Forest(start, np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """doc_id, text, y of at most about ``rows`` labelled documents, chosen by a hash of doc_id.

    Only identifiers with crc32(doc_id as text) mod 3 other than 1; null labels and texts count as none.
    """
    known = columns(labels, doc_id=T.LongType(), **{target: T.IntegerType()})
    known = known.where(f"doc_id is not null and {target} is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 != 1")
    known = known.groupBy("doc_id").agg(F.max(target).alias("y"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    return columns(docs, doc_id=T.LongType(), text=T.StringType()).join(known, "doc_id").where("text is not null").select("doc_id", "text", "y")


_TRAIN = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = [statistics(t)[1] for t in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(x, pa.list_(pa.float64()))], names=_TRAIN.names)

    found = labelled_sample(docs, labels, "quality", rows).mapInArrow(work, _TRAIN).toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever the order of arrival
    return train(x[order], y[order])


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """Per row of ``docs`` the base statistics, base_failed, kept and the model's score.

    Null, empty and blank texts have no words: all counts 0, base_failed true. Repeated rows each get a row;
    extra columns are ignored; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            both = [statistics(t) for t in as_bytes(part.column(1))]
            base = np.array([b for b, _ in both], np.int64)
            score = forest.score(np.array([x for _, x in both]))
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            kept = ~failed & (score >= KEEP_AT)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(score)], names=_OUT.names)

    return columns(docs, doc_id=T.LongType(), text=T.StringType()).mapInArrow(work, _OUT)


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return judge(docs, fit(docs, labels, rows))
