"""Concatenate and cut: documents' ids in one long row, cut into windows of a fixed length.

Two passes. The first encodes each partition once, writes the ids with their place in the partition, and so
gives each partition's total; a prefix sum over these few totals is each partition's global offset. The
second cuts each document where a multiple of the window falls. A window that spans two partitions is two
boundary records, one from each side; ``sequences`` joins only those, whole windows never move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import columns, cut, slices

WINDOW = 1024

_PASS1 = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("padded_tokens", T.LongType()),
    ]
)
SEQUENCES = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """First pass, written: part, doc_id, place (ids before it in the partition), n, ids."""
    path = tokenizer or tokens.tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for piece in slices(batches, rows=512, size=1 << 20, operator=tokens.OPERATOR):
            encoder = tokens.encoder(path)
            wide = encoder.dtype.itemsize
            values = encoder.encode(piece.column(1).to_pylist())
            n = np.array([len(v) // wide for v in values], np.int64)
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), piece.column(0), pa.array(places), pa.array(n), pa.array(values, pa.binary())], names=_PASS1.names)

    return cut(columns(docs, doc_id=T.LongType(), text=T.StringType()).mapInArrow(encode, _PASS1), "ids")


def offsets(ids: DataFrame) -> DataFrame:
    """part, base (ids of all partitions before), total (of all). A row for each partition of the first pass."""
    totals = ids.groupBy("part").agg(F.sum("n").alias("ids_in"))
    order = Window.orderBy("part")
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.sum("ids_in").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ids_in")
    return cut(totals.select("part", base.alias("base"), F.sum("ids_in").over(all_rows).alias("total")), "offsets")


def _id_width(tokenizer: str | None) -> int:
    return tokens.encoder(tokenizer or tokens.tokenizer_path()).dtype.itemsize


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """A row for each piece of a document in a sequence.

    Null and empty texts are one piece, the end id. Repeated rows are packed each for itself. The last
    sequence alone is shorter; it is padded to the window unless its length is a power of two. An empty
    table gives no rows.
    """
    wide = _id_width(tokenizer)
    ids = encoded(docs, tokenizer)
    placed = ids.join(offsets(ids), "part").select("doc_id", (F.col("base") + F.col("place")).alias("at"), "ids", "total")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(f"<u{wide}")
        for part in slices(batches, rows=2048, size=8 << 20):
            out: list[tuple] = []
            for doc_id, at, value, total in zip(*(c.to_pylist() for c in part.columns), strict=True):
                whole = np.frombuffer(value, dtype).astype("<u4")
                n, start = len(whole), 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    filled = min(window, total - sequence * window)
                    padded = filled if filled & (filled - 1) == 0 else window
                    out.append((doc_id, start, length, zlib.crc32(whole[start : start + length].tobytes()), n, sequence, offset, padded))
                    start += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=PIECES.names)

    return placed.mapInArrow(cut_up, PIECES)


def sequences(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (little-endian bytes, not padded)."""
    wide = _id_width(tokenizer)
    ids = encoded(docs, tokenizer)
    placed = ids.join(offsets(ids), "part").select("part", "place", (F.col("base") + F.col("place")).alias("at"), "ids")
    ordered = placed.repartition("part").sortWithinPartitions("part", "place")
    shape = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begin, held = None, 0, bytearray()

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal begin, held
            rows = []
            while held:
                sequence, offset = divmod(begin, window)
                size = (window - offset) * wide
                if len(held) < size and not last:
                    break
                rows.append((sequence, offset, bytes(held[:size])))
                begin += len(rows[-1][2]) // wide
                del held[:size]
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=shape.names)

        for piece in slices(batches, rows=2048, size=8 << 20):
            for p, at, value in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                if p != part:
                    yield from emit(True)
                    part, begin = p, at
                held += value
            yield from emit(False)
        yield from emit(True)

    parts = cut(ordered.mapInArrow(fill, shape), "windows")
    size = window * wide
    full = parts.where(F.length("ids") == size).select("sequence_id", F.lit(window).cast("long").alias("length"), "ids")
    boundary = parts.where(F.length("ids") < size).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = boundary.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return full.unionByName(joined.select("sequence_id", (F.length("ids") / wide).cast("long").alias("length"), "ids"))
