"""Toxicity by noisy-channel deobfuscation.

A word that may be disguised (signs or digits among its letters, letters drawn out, letters set apart) is a
lattice: each observed character may stand for the letters it is used for, may be a separator to drop, or a
repetition to drop, each at a cost. A Viterbi search over the lattice under a character 4-gram model of all
documents restores the likeliest reading: of the whole run, however long, and without a beam. A state is dropped
only if no rest of the run can bring it ahead of the best one. The restored text is scored by a lexicon of words and word beginnings
learned from labelled rows, and a logistic model over a text's strongest hits.

The character model counts every character of every document. The classifier learns from a bounded sample
(``TRAIN_ROWS``) of labelled rows; each of its rows is scored without its own contribution to the lexicon.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, columns, cut, slices
from .quality import labelled_sample

TRAIN_ROWS = 20_000
LEXICON = 5_000
REJECT_AT = 0.7
LEAST_SEEN = 2
PREFIXES = (4, 5, 6, 7, 8)
FORMS = (2, 3, 5)
CACHE_WORDS = 200_000

# Character classes of the language model: 0 border, 1-26 a-z, 27 any other letter.
CLASSES = 28
ORDER = 4

# Letters that a sign is used for; costs in nats.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = ".-_*·~'^`/\\,:"
COST_LEET, COST_DROP_SIGN, COST_BREAK, COST_SEPARATOR, COST_REPEAT, COST_KEEP_REPEAT = 1.0, 4.0, 2.5, 0.7, 0.3, 1.5
STATISTICS = 6

_EDGE = ".,;:!?\"'()[]{}<>«»…*%&#$-_=|/\\+^~`"
_LEFT_EDGE = _EDGE.replace("$", "").replace("|", "").replace("+", "")
#: at a word's end these are letters rather than marks
_LAST_SIGNS = "$|+"
_PLAIN_EDGE = "".join(sorted(set(_EDGE) - set(_LAST_SIGNS)))
#: letters set apart: four or more single characters between single separators
_APART = re.compile(r"(?<![^\s])[^\W_](?:[ .\-_*][^\W_]){3,}(?![^\s.,;:!?])")


def class_of(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


_BYTE_CLASS = np.zeros(256, np.uint8)
_BYTE_CLASS[97:123] = np.arange(1, 27)
_BYTE_CLASS[65:91] = np.arange(1, 27)
_BYTE_CLASS[192:256] = 27  # first byte of another letter; its further bytes are left out


def gram_counts(texts: Iterable[bytes | None]) -> np.ndarray:
    """Counts of the character 4-grams of all texts, each text between borders."""
    joined = b" " * ORDER + (b" " * ORDER).join(t or b"" for t in texts)
    raw = np.frombuffer(joined, np.uint8)
    c = _BYTE_CLASS[raw[(raw & 0xC0) != 0x80]].astype(np.int32)
    code = ((c[:-3] * CLASSES + c[1:-2]) * CLASSES + c[2:-1]) * CLASSES + c[3:]
    counts = np.bincount(code, minlength=CLASSES**ORDER)
    counts[0] = 0
    return counts


@dataclass
class CharModel:
    """-log p(c | three characters before), interpolated with shorter contexts."""

    cost: np.ndarray

    @functools.cached_property
    def margin(self) -> float:
        """How much a state may lie behind the best one and still end up ahead: with the same rest of the run the
        two differ in three contexts, and in a break that one of them may not make and drops instead."""
        return 3 * float(self.cost.max() - self.cost.min()) + COST_DROP_SIGN

    @functools.cached_property
    def flat(self) -> list[float]:
        """The costs as plain numbers, at ((x * CLASSES + y) * CLASSES + z) * CLASSES + c."""
        return self.cost.ravel().tolist()

    def __getstate__(self) -> dict:
        return {"cost": self.cost}  # what is derived from it is derived again, once a task

    @staticmethod
    def of(counts: np.ndarray) -> "CharModel":
        four = counts.reshape((CLASSES,) * ORDER).astype(np.float64)
        p = np.full(CLASSES, 1 / CLASSES)
        for n in range(ORDER):
            c = four.sum(axis=tuple(range(ORDER - 1 - n)))
            total = c.sum(axis=-1, keepdims=True)
            p = (c + 4 * p) / (total + 4)  # what shorter contexts say counts as four more observations
        return CharModel((-np.log(p)).astype(np.float32))

    def restore(self, seen: str) -> str:
        """The likeliest reading of a lower-case word; words of the reading are set apart by spaces."""
        cost, margin = self.flat, self.margin
        # state: last three classes as one number, last character -> (cost, reading so far as a chain)
        states: dict[tuple[int, str], tuple[float, tuple | None]] = {(0, ""): (0.0, None)}
        for i, c in enumerate(seen):
            options: list[tuple[str, float]] = []
            if c.isalpha():
                again = i > 0 and seen[i - 1] == c
                drawn = again and ((i > 1 and seen[i - 2] == c) or (i + 1 < len(seen) and seen[i + 1] == c))
                options.append((c, COST_KEEP_REPEAT if drawn else 0.0))
                if drawn:
                    options.append(("", COST_REPEAT))
            else:
                if c in LEET:
                    options += [(to, COST_LEET) for to in LEET[c]]
                    options.append(("", COST_DROP_SIGN))
                elif c in SEPARATORS or c == " ":
                    options.append(("", COST_SEPARATOR))
                else:
                    options.append(("", COST_DROP_SIGN))
                options.append((" ", COST_BREAK))
            ways = [(to, extra, 0 if to == " " else class_of(to) if to else -1) for to, extra in options]
            after: dict[tuple[int, str], tuple[float, tuple | None]] = {}
            for (context, last), (so_far, chain) in states.items():
                for to, extra, k in ways:
                    if k < 0:
                        key, value = (context, last), so_far + extra
                    elif k == 0:
                        if last in ("", " "):
                            continue
                        key, value = (0, " "), so_far + extra + cost[context * CLASSES]
                    else:
                        code = context * CLASSES + k
                        key, value = (code % CLASSES**3, to), so_far + extra + cost[code]
                    if key not in after or value < after[key][0]:
                        after[key] = (value, (chain, to) if to else chain)
            if len(after) > 8:
                most = min(v for v, _ in after.values()) + margin
                after = {key: found for key, found in after.items() if found[0] <= most}
            states = after
        _, chain = min(((v + cost[context * CLASSES], chain) for (context, _), (v, chain) in states.items()), key=lambda end: end[0])
        out: list[str] = []
        while chain is not None:
            chain, to = chain
            out.append(to)
        return "".join(reversed(out)).strip()


def _drawn_out(text: str) -> bool:
    raw = np.frombuffer(text.encode(), np.uint8)
    return len(raw) > 2 and bool(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] >= 97)).any())


class Restorer:
    """Distinct words of a text after restoration; keeps the readings of disguised words."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, str] = {}

    def reading(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            self.known[word] = self.model.restore(word)
        return self.known[word]

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        drawn = _drawn_out(low)
        out: set[str] = set()
        for token in set(low.split()):
            if token.isalpha() and not drawn:
                out.add(token)
                continue
            core = token.rstrip(_EDGE).lstrip(_LEFT_EDGE)
            tail = token.rstrip(_PLAIN_EDGE)
            if core and tail[-1] in _LAST_SIGNS:
                out.update(self.reading(core + tail[len(tail.rstrip(_LAST_SIGNS)) :]).split())
            if core.isalpha() and not (drawn and _drawn_out(core)):
                out.add(core)
            elif len(core) > 2 and any(map(str.isalpha, core)):
                out.update(self.reading(core).split())
                out.update(p for p in re.split(r"[\W\d_]+", core) if len(p) > 2)
        for m in _APART.finditer(low):
            out.update(self.reading(m.group()).split())
        return out

    def marks(self, text: str | None, wanted: frozenset[str] | None = None) -> set[str]:
        """Words of three letters or more, beginnings of longer words, and beginnings that several different
        words share: an inflected stem stands out by its forms. ``wanted``: the beginnings that matter."""
        out: set[str] = set()
        starts: dict[str, int] = {}
        for w in self.words(text):
            size = len(w)
            if size > 2:
                out.add(w)
                for n in PREFIXES:
                    if size > n:
                        start = w[:n]
                        if wanted is None or start in wanted:
                            starts[start] = starts.get(start, 0) + 1
        for start, forms in starts.items():
            out.add("^" + start)
            for least in FORMS:
                if forms >= least:
                    out.add(f"^{start}/{least}")
        return out


@dataclass
class Classifier:
    pos: int = 0
    neg: int = 0
    lexicon: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)

    def odds(self, pos: int, neg: int) -> float:
        if pos < LEAST_SEEN:
            return 0.0
        return math.log((pos + 0.5) / (self.pos + 1)) - math.log((neg + 0.5) / (self.neg + 1))

    def hits(self, marks: set[str], own: int | None = None) -> list[float]:
        """Statistics of a text; ``own``: its label, if it is among the rows counted in the lexicon."""
        found, words = [], 0
        for m in marks:
            words += m[0] != "^"
            if m in self.lexicon:
                p, n = self.lexicon[m]
                found.append(self.odds(p - (own == 1), n - (own == 0)))
        found = sorted((x for x in found if x > 0), reverse=True)
        top = found[0] if found else 0.0
        return [1.0, top, sum(found[:3]) / 3, sum(found[:12]) / 12, math.log1p(sum(1 for x in found if x > 2)), math.log1p(words)]

    def starts(self) -> frozenset[str]:
        return frozenset(m[1:].split("/")[0] for m in self.lexicon if m[0] == "^")

    def score(self, marks: set[str]) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.hits(marks), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Newton steps for the penalized log loss; the first column is the constant and not penalized."""
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = math.log(rate / (1 - rate))
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - y) + penalty @ w)
        size = np.abs(step).max()
        w -= step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w.tolist()


_GRAMS = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("n", T.LongType())])


def char_model(docs: DataFrame) -> CharModel:
    """From all characters of all documents. Each task sums its texts; the driver gets one count for each of
    at most ``CLASSES ** ORDER`` 4-grams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in slices(batches, rows=2048, size=4 << 20):
            counts = gram_counts(as_bytes(part.column(0)))
            total = counts if total is None else total + counts
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=_GRAMS.names)

    found = columns(docs, text=T.StringType()).mapInArrow(work, _GRAMS).groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES**ORDER)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return CharModel.of(counts)


_MARKS = T.StructType([T.StructField("mark", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("neg", T.LongType())])
_ROWS = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def fit(docs: DataFrame, labels: DataFrame, model: CharModel, rows: int = TRAIN_ROWS) -> Classifier:
    sample = labelled_sample(docs, labels, "toxic", rows)
    sample = cut(sample.groupBy(F.xxhash64("text").alias("copy")).agg(F.min_by("text", "doc_id").alias("text"), F.max("y").alias("y")).drop("copy"), "labelled")
    totals = sample.agg(F.sum("y").alias("pos"), F.count("*").alias("n")).first()
    pos = int(totals["pos"] or 0)
    classifier = Classifier(pos, int(totals["n"]) - pos)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, both = Restorer(model), (Counter(), Counter())
        for part in slices(batches):
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                both[1 - y].update(restorer.marks(text))
        names = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[0][m] for m in names], pa.int64()), pa.array([both[1][m] for m in names], pa.int64())], names=_MARKS.names)

    summed = sample.mapInArrow(count, _MARKS).groupBy("mark").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (classifier.pos + 1)) - F.log((F.col("neg") + 0.5) / (classifier.neg + 1))
    best = summed.where(F.col("pos") >= LEAST_SEEN).withColumn("odds", odds).where("odds > 1").orderBy((F.col("odds") * F.sqrt("pos")).desc(), "mark").limit(LEXICON)
    classifier.lexicon = {r["mark"]: (r["pos"], r["neg"]) for r in best.collect()}

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for part in slices(batches):
            labels = part.column(1).to_pylist()
            x = [classifier.hits(restorer.marks(t), y) for t, y in zip(part.column(0).to_pylist(), labels, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=_ROWS.names)

    found = sample.mapInArrow(hit, _ROWS).toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, STATISTICS)
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    classifier.weights = logistic(x[order], y[order])
    return classifier


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: CharModel, classifier: Classifier) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. A null text scores as an empty one, whose words are none."""

    wanted = classifier.starts()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for part in slices(batches):
            s = np.array([classifier.score(restorer.marks(t, wanted)) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= REJECT_AT).astype(np.int32))], names=_OUT.names)

    rows = columns(docs, doc_id=T.LongType(), text=T.StringType())
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", "text", held.alias("held_out")).mapInArrow(work, _OUT)


def without_toxic(docs: DataFrame, model: CharModel, classifier: Classifier) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic.

    A null text, or a table without the column, scores as an empty text. Repeated rows stay or go together; an
    empty table gives no rows. Other columns are passed on as they are.
    """
    wanted = classifier.starts()
    place = next((k for k, c in enumerate(docs.columns) if c.lower() == "text"), None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for part in slices(batches):
            texts = [None] * part.num_rows if place is None else part.column(place).to_pylist()
            yield part.filter(pa.array([classifier.score(restorer.marks(t, wanted)) < REJECT_AT for t in texts], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[CharModel, Classifier]:
    model = char_model(docs)
    return model, fit(docs, labels, model, rows)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Scores of all rows of ``docs``. Repeated rows each get a row and score alike; extra columns are ignored;
    an empty table gives no rows; without labels every score is the same."""
    return score(docs, *fitted(docs, labels, rows))


def restored(docs: DataFrame, model: CharModel) -> DataFrame:
    """doc_id and the restored distinct words of each text, for inspection."""
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sorted(restorer.words(t)) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], names=shape.names)

    return columns(docs, doc_id=T.LongType(), text=T.StringType()).mapInArrow(work, shape)
