"""Small helpers shared by the operators of this subpackage."""

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _local(spark: SparkSession) -> bool:
    """Whether driver and executor are one process."""
    return bool(re.match(r"local($|\[)", spark.sparkContext.master))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared checkpoint folder; only in local mode (tests) is that setting not needed."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Fewer rows in an Arrow batch: whole texts and sets make large rows, and a batch is held twice, by executor and worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, scanned: int | None = None) -> Iterator[None]:
    """``BATCH`` while something is written; ``scanned`` bounds the rows that a scan decodes at once."""
    bounds = BATCH | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} | ({"spark.sql.parquet.columnarReaderBatchSize": str(scanned)} if scanned else {})
    before = {k: spark.conf.get(k) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def written(df: DataFrame, tag: str, scanned: int | None = None) -> DataFrame:
    """Cuts the lineage: the rows go to a Parquet table in the shared folder and are read from there, until the application ends.
    ``scanned``: for input of few, large rows, how many a scan decodes at once."""
    path = scratch(df.sparkSession, tag)
    with small_batches(df.sparkSession, scanned=scanned):
        df.write.parquet(path)
    _located(df.sparkSession, path, lambda files, place: files.deleteOnExit(place))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for table in tables:
        _located(table.sparkSession, _PATHS.pop(table), lambda files, place: files.delete(place, True))


def _located(spark: SparkSession, path: str, act: Callable[[object, object], object]) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(place.getFileSystem(spark._jsc.hadoopConfiguration()), place)


def release(spark: SparkSession, workers: bool = True) -> None:
    """After a large step: files of its shuffles stay on the executors until the driver collects the plans that made them.
    A short job then lets the executors collect, since a heap shrinks at a full collection only, and their workers free what they keep;
    without ``workers`` that job runs no Python."""
    _give_back()
    spark._jvm.System.gc()
    if not _local(spark):
        slots = spark.sparkContext.defaultParallelism
        collected = spark.range(0, slots, 1, slots).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("collected"))
        (collected.mapInArrow(_emptied, "collected string") if workers else collected.where("collected is not null")).collect()


def _emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """No rows; the worker forgets its tables after its input, so after the executor has collected."""
    for _ in batches:
        pass
    forget()
    trim()
    yield from ()


def _give_back() -> None:
    """What this process no longer uses goes back to the system."""
    gc.collect()
    trim()


def trim() -> None:
    """Free pages go back to the system."""
    pa.default_memory_pool().release_unused()
    if freed := getattr(ctypes.CDLL(None), "malloc_trim", None):
        freed(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A step whose worker hands free pages back when a task ends: it waits beside an executor that may need them."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return told


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def beside(rows: DataFrame, few: DataFrame, on: list[str], how: str, most: int = 500_000) -> DataFrame:
    """Join with a table that was written: sent to all tasks up to ``most`` rows (counted), met in a shuffle beyond."""
    return rows.join(F.broadcast(few) if few.count() <= most else few, on, how)


#: What a Python worker keeps from task to task: the tables of one operator at a time.
_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """The tables under a key, made when first asked for; those of any other key go."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Frees what an earlier operator keeps, for one that needs the worker's memory, and hands free pages back to the system."""
    if _KEPT:
        _KEPT.clear()
        _give_back()


def fold_of(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def sample_share(count: int, bound: int) -> float:
    """The share of rows that keeps a sample below the bound."""
    return min(1.0, bound / max(count, 1))


def in_share(id_col: str, share: float, salt: int = 17) -> Column:
    """A repeatable sample: rows whose id hashes into the lowest share of the hash range."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(salt)), 1) < int(share * 2**63)


def in_parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in one string or binary column; a row each at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    for own in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
        if len(own):
            yield batch.slice(int(own[0]), len(own))


def kind_of(df: DataFrame, column: str) -> str:
    """SQL type text of a column."""
    return df.schema[column].dataType.simpleString()
