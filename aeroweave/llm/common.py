"""Helpers shared by the corpus operators: shared storage, input columns, batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a temporary folder stands in for it; on a cluster that is
    an error, since executors would write where nobody else can read.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="aeroweave-")
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_passing: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes meanwhile are deleted at the end, but those that it is told to keep."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer the real size of the table. ``keep``: the
    table outlives ``passing``.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    if _passing and not keep:
        _passing[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches to Python of ``BATCH_BYTES``, not of 10,000 texts, unless the session has its own bound."""
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def columns(df: DataFrame, **types: T.DataType) -> DataFrame:
    """Just the named columns, cast; a column that is missing is null. Extra columns never clash."""
    bounded_batches(df.sparkSession)
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[n.lower()]}`").cast(t) if n.lower() in have else F.lit(None).cast(t)).alias(n) for n, t in types.items()])


#: Caches of a Python worker that are worth keeping within a task only.
task_caches: list[dict] = []
#: Caches worth keeping from task to task of one operator: its name, and what drops them.
operator_caches: dict[str, Callable[[], None]] = {}


def give_back(operator: str | None = None) -> None:
    """Memory that a task no longer needs goes back to the system: a worker serves many tasks, and the next one
    may be of another operator, for which only caches of ``operator`` stay."""
    for cache in task_caches:
        cache.clear()
    for name, drop in operator_caches.items():
        if name != operator:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 20, operator: str | None = None) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of Arrow batches, so that only a few texts at a time become Python objects.

    ``size`` bounds the bytes of a slice of ordinary rows; one longer text is a slice of its own.
    """
    give_back(operator)  # what an operator before this one left
    try:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            step = max(1, min(rows, int(size * n / max(1, b.nbytes))))
            for i in range(0, n, step):
                yield b.slice(i, step)
    finally:
        give_back(operator)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, array: str | None = None) -> DataFrame:
    """Broadcast a written table of numbers only if it has few bytes; else the join shuffles.

    ``array``: a column of arrays of numbers, whose elements count as well.
    """
    elements = F.sum(F.size(array)) if array else F.lit(0)
    found = df.agg(F.count("*").alias("n"), elements.alias("more")).first()
    size = 8 * (found["n"] * 2 * len(df.columns) + (found["more"] or 0))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
