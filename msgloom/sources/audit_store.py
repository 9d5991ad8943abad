"""The audit log as a table of days: time bounds prune folders, retention rewrites one day, pages go on from a key.

Entries lie under ``date=yyyy-mm-dd`` (UTC, as the session's zone should be), those without a time in the null folder. A
batch is dealt by ranges of time before it is written, so a day has few files, each with a narrow range of times.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.operators.audit import audit_rows, query_audit
from msgloom.sources.scratch import written

_DYNAMIC = "partitionOverwriteMode"


def append(df: DataFrame, path: str) -> None:
    """Add entries (as logged, or as :func:`audit_rows` gives them) to the store."""
    dated = audit_rows(df).withColumn("date", F.to_date("timestamp"))
    dated.repartitionByRange("date", "timestamp").write.mode("append").partitionBy("date").parquet(path)


def between(store: DataFrame, start: str | datetime | None = None, end: str | datetime | None = None) -> DataFrame:
    """The entries from ``start`` to ``end`` (included); only folders of those days are listed and read."""
    if start is not None:
        at = F.lit(start).cast("timestamp")
        store = store.filter((F.col("date") >= F.to_date(at)) & (F.col("timestamp") >= at))
    if end is not None:
        at = F.lit(end).cast("timestamp")
        store = store.filter((F.col("date") <= F.to_date(at)) & (F.col("timestamp") <= at))
    return store


def read(spark: SparkSession, path: str, start: str | datetime | None = None, end: str | datetime | None = None) -> DataFrame:
    return between(spark.read.parquet(path), start, end)


def behind(time: str, key: str, after: tuple[datetime | None, str], ascending: bool = False) -> Column:
    """Whether a row comes after the key ``(time, id)`` in order of falling times, null ones last, and of ids."""
    at, id_ = after
    later = F.col(key) > F.lit(id_) if ascending else F.col(key) < F.lit(id_)
    if at is None:
        return F.col(time).isNull() & later
    return F.col(time).isNull() | (F.col(time) < F.lit(at)) | ((F.col(time) == F.lit(at)) & later)


def query(spark: SparkSession, path: str, entry_type: str | None = None, start: str | None = None, end: str | None = None, client_ip: str | None = None, limit: int | None = None, after: tuple[datetime | None, str] | None = None) -> DataFrame:
    """:func:`query_audit` over the store. ``after``: the last page's last ``(timestamp, event_id)``; nothing before it is sorted."""
    rows = read(spark, path, start, end)
    if after is not None:
        rows = rows.filter(behind("timestamp", "event_id", after))
        if after[0] is not None:
            rows = rows.filter(F.col("date").isNull() | (F.col("date") <= F.lit(after[0].date())))
    return query_audit(rows, entry_type, client_ip=client_ip, limit=limit)


def event_page(events: DataFrame, limit: int = 20, after: tuple[datetime | None, str] | None = None) -> DataFrame:
    """The ``limit`` newest events behind ``after`` (the last page's last ``(eventTime, id)``), and whether more follow.

    The page is sorted as the smallest keys of each partition; it counts nothing and skips nothing.
    """
    if after is not None:
        events = events.filter(behind("eventTime", "id", after, ascending=True))
    page = events.orderBy(F.desc("eventTime"), "id").limit(limit + 1)
    one = page.agg(F.collect_list(F.struct(*page.columns)).alias("rows"))  # a page
    more = F.size("rows") > limit
    return one.select(more.alias("has_more"), F.explode(F.slice("rows", 1, limit)).alias("x")).select("x.*", "has_more")


def _days(spark: SparkSession, path: str) -> dict[date, str]:
    """The folders of days."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm)
    names = [x.getPath().getName() for x in listed if x.isDirectory()]
    return {date.fromisoformat(x[5:]): f"{path}/{x}" for x in names if x.startswith("date=") and x[5:6].isdigit()}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def retain(spark: SparkSession, path: str, now: datetime, days: int = 90, archive: str | None = None) -> None:
    """Entries older than ``days`` leave the store, for ``archive`` if there is one.

    Days before the limit go as folders, unread unless archived. The limit's own day is rewritten, in place of itself alone.
    Entries that the archive has already are not added again, so a run that was cut short can be repeated.
    """
    limit = F.lit(now) - F.make_dt_interval(F.lit(days))
    last = spark.range(1).select(F.to_date(limit)).head()[0]
    folders = {d: f for d, f in _days(spark, path).items() if d <= last}
    if not folders:
        return
    store = spark.read.parquet(path)
    if archive is not None:
        old = store.filter((F.col("date") <= F.lit(last)) & (F.col("timestamp") < limit))
        if _exists(spark, archive):
            there = spark.read.parquet(archive).filter((F.col("date") >= F.lit(min(folders))) & (F.col("date") <= F.lit(last)))
            old = old.join(there.select("date", "event_id"), ["date", "event_id"], "left_anti").select(*store.columns)
        old.repartitionByRange("date", "timestamp").write.mode("append").partitionBy("date").parquet(archive)
    if last in folders:
        kept = written(store.filter((F.col("date") == F.lit(last)) & (F.col("timestamp") >= limit)), "kept")
        if kept.take(1):
            kept.write.mode("overwrite").option(_DYNAMIC, "dynamic").partitionBy("date").parquet(path)
            del folders[last]
    for folder in folders.values():
        _delete(spark, folder)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
