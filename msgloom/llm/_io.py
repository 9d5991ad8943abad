"""Shared helpers of the training-data operators: written intermediates and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where it is unset, a temporary one if all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="msgloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: The tables of each :func:`passing` that is open in this thread.
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with a copy that outlives any executor, and keeps columns prunable for later reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _open.get():
        _open.get()[-1].append(out)
    return out


def forget(*written: DataFrame) -> None:
    """Delete the files of :func:`materialize` results that no later step reads."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, tables of :func:`materialize` are intermediate: they go at its end, but for those that the given function is called with."""
    own: list[DataFrame] = []
    token = _open.set((*_open.get(), own))
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.written_to)
        return df

    done = False
    try:
        yield keep
        done = True
    finally:
        _open.reset(token)
        forget(*(x for x in own if not done or x.written_to not in kept))
        if done and _open.get():
            _open.get()[-1].extend(x for x in own if x.written_to in kept)


def text_or_empty(df: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``text`` alone, a null text as the empty one."""
    return df.select(*keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Memory that this process has freed goes back to the system; allocators else keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(task: Callable) -> Callable:
    """``task`` (of Arrow batches), by a worker that gives memory back before and after it.

    Workers live on from task to task and from stage to stage, and would keep the most that any of their tasks took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def pieces_of(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose ``column`` holds about ``most_bytes`` bytes (one row at least)."""
    _, offsets = buffer_of(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes, and where each row starts and the last one ends (nulls are empty)."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def holds(found: DataFrame, bits: int = 26) -> Callable:
    """A function of key columns that tells whether the key can be in ``found`` (its columns), by a bitmap: no row moves.

    The bitmap is ``2**bits`` bits whatever the input (a fuller one only lets more rows through), so what follows must
    still join with ``found``.
    """
    top = 64 - bits
    rows = found.select(F.xxhash64(*found.columns).alias("key")).select(F.shiftrightunsigned("key", top + 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {top}) & 63 as int))").alias("mask"))
    rows = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    shared = found.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf(T.BooleanType())
    def inside(keys: pd.Series) -> pd.Series:
        at = (keys.to_numpy(np.int64).astype(np.uint64) >> np.uint64(top)).astype(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda *columns: inside(F.xxhash64(*columns))


def only_keys_of(df: DataFrame, column: str, found: DataFrame, bits: int = 26) -> DataFrame:
    """Rows of ``df`` whose ``column`` can be in ``found``'s only column (:func:`holds`)."""
    return df.filter(holds(found, bits)(column))


def placed(df: DataFrame, *needed: str) -> DataFrame:
    """``whole, file, at``: each row's columns as a struct, under any names, and its place, by which later reads tell it apart.

    A Parquet table is read where it lies. Anything else is written first (``needed`` columns alone, if any are named),
    since rows that are computed again need not come in the same order.
    """
    table = df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in df.columns
    try:
        table = table and "row_index" in df.select("_metadata").schema[0].dataType.names
    except AnalysisException:  # a relation that isn't made of files
        table = False
    if table:
        base, whole = df, F.struct("*")
    else:
        base, whole = materialize(df.select(F.struct(*(needed or "*")).alias("whole")), "placed"), F.col("whole")
    return base.select(whole.alias("whole"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def running_start(df: DataFrame, part: str, size: str, start: str) -> DataFrame:
    """``part`` with the sum of ``size`` over all smaller parts: a window over one row per partition."""
    totals = df.groupBy(part).agg(F.sum(size).alias("_size"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("long").alias(start))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` (written), with ``index``: a row's place, from 0, among those of its ``group`` in ``order`` (nulls first).

    Rows are dealt by ranges of (group, order), so a large group is many tasks' work. A task numbers its own runs; what a
    run that began in an earlier partition has to add comes from one row a partition.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, at, run = TaskContext.get().partitionId(), 0, None, 0, -1
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            keys = batch.column(group)
            a, b = keys.slice(1), keys.slice(0, n - 1)
            new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[run < 0 or keys[0].as_py() != last], new])
            runs = run + np.cumsum(starts)
            first = np.where(starts, np.arange(n), 0)
            first[0] = 0 if starts[0] else -at
            places = np.arange(n) - np.maximum.accumulate(np.where(starts, first, first[0]))
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(places), pa.array(runs == 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_part", "_row", "_at", "_lead"])
            last, at, run, row = keys[n - 1].as_py(), int(places[-1]) + 1, int(runs[-1]), row + n

    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_lead", T.BooleanType())])
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    own = materialize(dealt.mapInArrow(place, schema), name)
    ends = own.groupBy("_part").agg(F.min_by(group, "_row").alias("first"), F.max_by(group, "_row").alias("last"), F.max_by("_at", "_row").alias("at"), F.max("_row").alias("row"))
    bases, before, n = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # a row a partition
        base = n if before is not None and before["last"] == r["first"] else 0
        bases += [(r["_part"], base)] if base else []
        before, n = r, r["at"] + 1 + (base if r["at"] == r["row"] else 0)
    more = df.sparkSession.createDataFrame(bases, "_part int, _base long")
    index = F.col("_at") + F.when(F.col("_lead"), F.coalesce("_base", F.lit(0))).otherwise(0)
    return own.join(F.broadcast(more), "_part", "left").withColumn("index", index).select(*df.columns, "index")


LONG, INT, DOUBLE, STRING, BINARY = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType()
