"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should have; the whole part is
certain, the fraction is a probability. Two documents at a time, words move from one to the other until one
of them is in or out for good; the direction is random so that no document's expectation changes, and the
moved words are equal, so the source's expected words stay what they were. Each block of a source leaves at
most one document undecided. These residuals meet in blocks of blocks, level by level, until one document a
source is left, whose fraction is drawn. So a source misses its target by less than one document.

All draws are hashes of the identifiers and the seed: reruns agree, whatever the partitions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, cut, passing, small

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = 17
FAN_IN = 256

_UNIT = T.StructType(
    [
        T.StructField("unit", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("times", T.LongType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("copies", T.LongType()),
        T.StructField("part", T.DoubleType()),
        T.StructField("block", T.LongType()),
        T.StructField("blocks", T.LongType()),
    ]
)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_key() -> Column:
    """Rows that agree in identifier, source and text are one unit and get the same number of copies."""
    return F.xxhash64("doc_id", "source", "text")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source (code point order, null last): source_size, units, target.

    The level at which every source gets weight * level words or its cap, whichever is less, and all get what
    there is: sources sorted by cap over weight, those are capped whose cap lies below the level that the
    sources before them leave. One row a source goes through one task.
    """
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("units"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("place", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    every = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "place")
    all_rows = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("source_size").cast("double")).over(all_rows)
    weight = F.sum("weight").over(all_rows)
    left = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    flagged = ranked.withColumns({"total": total, "weights": weight, "capped": left > F.col("cap") / F.col("weight")})
    held = F.when(F.col("capped"), F.col("cap")).otherwise(0.0)
    held_weight = F.when(F.col("capped"), F.col("weight")).otherwise(0.0)
    level = F.try_divide(F.col("total") - F.sum(held).over(all_rows), F.col("weights") - F.sum(held_weight).over(all_rows))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))
    return flagged.select("source", "source_size", "units", target.alias("target"))


def _draw(seed: int, *what: int) -> float:
    return (xxhash.xxh3_64_intdigest(struct.pack(f"<{len(what)}q", *what), seed) >> 11) / (1 << 53)


def move(one: tuple[float, int], two: tuple[float, int], draw: float) -> tuple[float, float]:
    """New fractions of two units (fraction, words); at least one of them is 0 or 1."""
    (p, v), (q, w) = one, two
    up, down = min((1 - p) * v, q * w), min(p * v, (1 - q) * w)
    if draw * (up + down) < down:  # the first gains, the second loses
        return (1.0, max(0.0, q - up / w)) if (1 - p) * v <= q * w else (min(1.0, p + up / v), 0.0)
    return (0.0, min(1.0, q + down / w)) if p * v <= (1 - q) * w else (max(0.0, p - down / v), 1.0)


def _settled(p: float) -> bool:
    return p < 1e-12 or p > 1 - 1e-12


def _round_blocks(seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        out: list[dict] = []

        def done(row: dict) -> None:
            row["copies"] += int(row["part"] > 0.5)
            row["part"] = 0.0
            out.append(row)

        def close() -> None:
            if held is None:
                return
            if held["blocks"] == 1:
                held["part"] = 1.0 if _draw(seed, held["unit"], -1) < held["part"] else 0.0
                done(held)
            else:
                out.append(held)

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["source"], row["block"])
                if key != group:
                    close()
                    group, held = key, None
                if not row["size"]:  # no words to move: drawn by itself
                    row["part"] = 1.0 if _draw(seed, row["unit"], -2) < row["part"] else 0.0
                if _settled(row["part"]):
                    done(row)
                    continue
                if held is None:
                    held = row
                    continue
                v, w = held["size"] * held["times"], row["size"] * row["times"]
                held["part"], row["part"] = move((held["part"], v), (row["part"], w), _draw(seed, held["unit"], row["unit"]))
                open_rows = []
                for r in (held, row):
                    if _settled(r["part"]):
                        done(r)
                    else:
                        open_rows.append(r)
                held = open_rows[0] if open_rows else None
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return work


_ARROW = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in _UNIT.fields])


def decided(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """Per unit: unit, doc_id, source, size, times, source_size, target, copies. A written table."""
    rows = columns(docs, doc_id=T.LongType(), source=T.StringType(), text=T.StringType())
    sized = rows.select(unit_key().alias("unit"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    units = cut(sized.groupBy("unit", "doc_id", "source", "size").agg(F.count("*").alias("times")), "units")
    targets = cut(source_targets(units, weights, most), "targets").withColumnRenamed("source", "name")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ready = units.join(targets, F.col("source").eqNullSafe(F.col("name"))).withColumn("each", each)
    ready = ready.withColumn("copies", F.floor(F.col("each") + 1e-12).cast("long"))
    ready = ready.withColumn("part", F.greatest(F.lit(0.0), F.col("each") - F.col("copies")))
    ready = ready.withColumn("blocks", F.ceil(F.col("units") / FAN_IN).cast("long"))
    ready = ready.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(seed)), F.col("blocks")))
    left, parts = ready.select(*_UNIT.names), []
    while True:
        dealt = left.repartition("source", "block").sortWithinPartitions("source", "block", F.xxhash64("unit", F.lit(seed + 1)), "unit")
        step = cut(dealt.mapInArrow(_round_blocks(seed), _UNIT), "rounded")
        parts.append(step.where("part = 0"))
        left = step.where("part > 0")
        if not left.take(1):
            break
        left = left.withColumns({"block": F.expr(f"block div {FAN_IN}"), "blocks": F.ceil(F.col("blocks") / FAN_IN).cast("long")})
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("part", "block", "blocks")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (size times copies), copies.

    Null texts and texts without words have size 0 and 0 taken words; a source without words has target 0.
    A null source is a source of its own, the last. Repeated rows get equal copies, each its own row. Extra
    columns are ignored. An empty table gives no rows.
    """
    rows = decided(docs, weights, most, seed).withColumn("again", F.explode(F.expr("sequence(1L, times)")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: all columns of ``docs``, each row as often as it has copies."""
    need = columns(docs, doc_id=T.LongType(), source=T.StringType(), text=T.StringType())
    with passing(docs.sparkSession):
        copies = decided(docs, weights, most, seed).where("copies > 0").groupBy(F.col("unit").alias("__taken")).agg(F.max("copies").alias("__copies"))
        copies = cut(copies, "copies", keep=True)  # two numbers a document: the texts move only where these are many
    names = docs.columns
    keyed = docs.withColumn("__unit", F.xxhash64(*[F.col(f"`{c}`").cast(t.dataType) for c, t in zip(("doc_id", "source", "text"), need.schema.fields, strict=True)]))
    joined = keyed.join(small(copies), F.col("__unit") == F.col("__taken"))
    return joined.withColumn("__again", F.explode(F.expr("sequence(1L, __copies)"))).select(*[F.col(f"`{n}`") for n in names])
