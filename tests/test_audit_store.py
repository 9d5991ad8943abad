"""The audit store: pruned reads, pages by key, retention in place."""

import io
import os
from contextlib import redirect_stdout
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from msgloom.operators import audit
from msgloom.sources import audit_store

SCHEMA = "timestamp timestamp, entry_type string, client_ip string, event_id string, text string"
START = datetime(2024, 1, 1, tzinfo=UTC)


def entries():
    """Six days, several entries at one time, and some without a time."""
    rows = [(START + timedelta(hours=6 * (k // 3)), ("prediction", "feedback")[k % 2], f"10.0.0.{k % 4}", f"id{k:03d}", f"text {k}") for k in range(72)]
    return rows + [(None, "prediction", "10.0.0.1", f"none{k}", None) for k in range(3)]


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = entries()
    audit_store.append(spark.createDataFrame(rows[:40], SCHEMA), path)
    audit_store.append(spark.createDataFrame(rows[40:], SCHEMA), path)
    return path


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def ids(df):
    return [r["event_id"] for r in df.collect()]


def test_bounds_prune_days(spark, store):
    bounds = "2024-01-02 06:00:00", "2024-01-03 12:00:00"
    got = audit_store.query(spark, store, "prediction", *bounds)
    assert "PartitionFilters: [isnotnull(date" in plan(got)
    want = audit.query_audit(spark.createDataFrame(entries(), SCHEMA), "prediction", *bounds)
    assert ids(got) == ids(want) and len(ids(got)) > 5
    files = {os.path.basename(os.path.dirname(f)) for f in audit_store.read(spark, store, *bounds).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert files == {"date=2024-01-02", "date=2024-01-03"}


def test_pages_by_key(spark, store):
    whole = ids(audit_store.query(spark, store))
    assert whole == ids(audit.query_audit(spark.createDataFrame(entries(), SCHEMA)))
    found, after = [], None
    while True:
        page = audit_store.query(spark, store, limit=7, after=after).collect()
        found += [r["event_id"] for r in page]
        if len(page) < 7:
            break
        at = page[-1]["timestamp"]
        after = (at and at.replace(tzinfo=None).astimezone(UTC) if at and at.tzinfo else at and datetime.fromtimestamp(at.timestamp(), UTC), page[-1]["event_id"])
    assert found == whole


def test_event_pages(spark, store):
    events = audit.to_events(spark.read.parquet(store).drop("date").withColumns({c: F.lit(None).cast("string") for c in ("label", "confidence", "model", "model_version", "feedback_id", "original_label", "user_feedback", "user_id", "endpoint", "reason", "attempted_action", "event_type", "message", "title", "description", "priority", "text_hash", "processing_time_ms", "text_length")}).withColumns({"thumbs_up": F.lit(None).cast("boolean"), "thumbs_down": F.lit(None).cast("boolean"), "redaction_applied": F.lit(None).cast("boolean"), "metadata": F.lit(None).cast("map<string,string>"), "characteristics": F.lit(None).cast("array<struct<name:string,value:string,valueType:string>>")}))
    whole = [r["id"] for r in events.orderBy(F.desc("eventTime"), "id").collect()]
    first = audit_store.event_page(events, 10).collect()
    last = first[-1]
    second = audit_store.event_page(events, 10, (last["eventTime"].astimezone(UTC) if last["eventTime"].tzinfo else datetime.fromtimestamp(last["eventTime"].timestamp(), UTC), last["id"])).collect()
    assert [r["id"] for r in first + second] == whole[:20] and all(r["has_more"] for r in first + second)
    assert [r["has_more"] for r in audit_store.event_page(events, len(whole)).collect()] == [False] * len(whole)


def stamps(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_retention_rewrites_one_day(spark, store, tmp_path):
    archive, before = str(tmp_path / "archive"), stamps(store)
    limit = START + timedelta(days=2, hours=12)
    for _ in range(2):  # a repeated run changes nothing
        audit_store.retain(spark, store, limit + timedelta(days=30), 30, archive)
    rows = entries()
    assert sorted(ids(spark.read.parquet(store))) == sorted(r[3] for r in rows if r[0] is None or r[0] >= limit)
    assert sorted(ids(spark.read.parquet(archive))) == sorted(r[3] for r in rows if r[0] is not None and r[0] < limit)
    after = stamps(store)
    assert {f.split("/")[0] for f in before.keys() - after.keys()} == {"date=2024-01-01", "date=2024-01-02", "date=2024-01-03"}
    assert all(before[f] == after[f] for f in after if not f.startswith("date=2024-01-03"))
    audit_store.retain(spark, store, limit + timedelta(days=31), 30)  # without an archive they go
    assert sorted(ids(spark.read.parquet(store))) == sorted(r[3] for r in rows if r[0] is None or r[0] >= limit + timedelta(days=1))
