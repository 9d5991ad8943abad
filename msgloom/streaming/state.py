"""What stateful streams share: the state store they need, rows kept there by the frame, and running one over all that is there.

A value of Python state is pickled and passes a socket, some 100 microseconds each. Rows that are written and read together
are therefore one value, an Arrow table as bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows kept as one value of state.
FRAME = "frame binary"


def packed(rows: pa.Table) -> tuple[bytearray]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return (bytearray(sink.getvalue()),)


def unpacked(values: Iterable[tuple]) -> pa.Table | None:
    """The rows of all values, or nothing."""
    tables = [pa.ipc.open_stream(pa.py_buffer(x[0])).read_all() for x in values]
    return pa.concat_tables(tables) if tables else None


def as_key(column: str) -> Column:
    """A key that is never null (pandas would turn integers beside a null into other keys)."""
    return F.coalesce(F.concat(F.lit("+"), F.col(column).cast("string")), F.lit(""))


def from_key(column: str, kind: T.DataType) -> Column:
    return F.when(F.col(column) != "", F.substring(column, 2, 1 << 30)).cast(kind)


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams started within it keep their state in RocksDB, on disk and beyond an executor's memory, in so many partitions.

    A stream keeps the number of its first start; without one given, it is the session's for shuffles, one a core at most.
    """
    own = {PROVIDER: ROCKSDB, PARTITIONS: str(partitions or min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def write_available(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """Run ``stream`` over all that is there into Parquet under ``path``, and read what the sink holds."""
    spark = stream.sparkSession
    with rocksdb(spark, partitions):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
