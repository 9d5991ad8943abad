"""Keyed state with timers: stream results equal the batch forms with late and out-of-order files, and state ends."""

import datetime
import random

import pytest

from msgloom.operators import traffic
from msgloom.streaming import batcher, receipts
from msgloom.streaming.state import write_available

DAY = datetime.datetime(2024, 1, 1)
SUBMITS, RECEIPTS = "message_id string, ts timestamp", "receipt_id long, ts timestamp, esm_class int, report string"


def at(us):
    return DAY + datetime.timedelta(microseconds=us)


def in_files(spark, rows, schema, path, files, swap, seed):
    """Rows in order of time dealt to files, with ``swap`` rows of neighbours exchanged and each file shuffled."""
    r = random.Random(seed)
    size = -(-len(rows) // files)
    chunks = [rows[k * size : (k + 1) * size] for k in range(files)]
    for a, b in zip(chunks, chunks[1:]):
        n = min(swap, len(a) // 2, len(b) // 2)
        a[len(a) - n :], b[:n] = b[:n], a[len(a) - n :]
    for chunk in chunks:
        r.shuffle(chunk)
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def left(spark, checkpoint, name, operator=0):
    return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(checkpoint).collect()


@pytest.fixture
def few(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_micro_batches(few, tmp_path):
    r, us, rows = random.Random(1), 0, []
    for i in range(600):
        us += r.choice([0, 1000, 5000, 5000, 20_000, 400_000])
        rows.append((r.randrange(3) if i % 50 else None, i, at(us)))
    schema = "instance int, message_id long, ts timestamp"
    stream = in_files(few, rows + [(9, 10**6, at(10**11))], schema, f"{tmp_path}/in", 6, 40, 2)
    got = write_available(batcher.micro_batches(stream, 8, 50.0, "1 minute"), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    want = traffic.micro_batch_assign(few.createDataFrame(rows, schema), 8, 50.0).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert [x["key"][0] for x in left(few, f"{tmp_path}/state", "waiting")] == ["+9"] and left(few, f"{tmp_path}/state", "open") == []


def traffic_rows():
    """Messages under ids that several receipts can mean, receipts too early, too late, twice, and without an id."""
    hour, r = 3_600_000_000, random.Random(7)
    sent, back, n = [], [], 0
    for k in range(120):
        t = k * hour // 2
        number = 4096 + k % 60  # every id is sent again 30 hours later
        for form in r.sample(range(3), r.choice([1, 1, 2])):
            sent.append(((str(number), f"{number:x}", f"0{number:x}")[form], at(t + form * 1000)))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            wait = r.choice([-hour, hour // 2, hour, 5 * hour, 23 * hour, 24 * hour, 30 * hour])
            back.append((n, at(t + wait + r.randrange(1000) if wait < 24 * hour else t + wait), 4, f"id:{number} sub:001"))
            n += 1
    back += [(n, at(5), 4, "no id here"), (n + 1, at(6), 0, "id:4096 not a receipt"), (n + 2, at(7 * hour), 5, "id:99999999999999999999999 x"), (n + 3, at(8 * hour), 4, "id:abc x")]
    return sorted(sent, key=lambda x: x[1]), sorted(back, key=lambda x: x[1])


def test_receipts(few, tmp_path):
    sent, back = traffic_rows()
    end = at(10**12)
    streams = (in_files(few, rows, schema, f"{tmp_path}/{name}", 4, 3, 5) for name, rows, schema in (("sent", [*sent, ("end", end)], SUBMITS), ("back", [*back, (-1, end, 4, "id:end ")], RECEIPTS)))
    got = write_available(receipts.settled_receipts(*streams, late="20 hours"), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    frames = few.createDataFrame(sent, SUBMITS), few.createDataFrame(back, RECEIPTS)
    matched = {r["receipt_id"]: (r["message_id"], r["form"], r["ts"]) for r in traffic.match_receipts(*frames).collect()}
    assert len(got) == len(back) and {r["receipt_id"] for r in got} == {r[0] for r in back}
    assert {r["receipt_id"]: (r["message_id"], r["form"], r["ts"]) for r in got if r["message_id"] is not None} == matched
    assert 20 < len(matched) < len(back) - 20 and {m[1] for m in matched.values()} == {0, 1, 2}
    assert len({(m[0], m[2]) for m in matched.values()}) == len(matched)
    states = few.read.format("state-metadata").load(f"{tmp_path}/state").select("operatorId", "operatorProperties").collect()
    rest = [x["key"][0] for r in states for name in ("sent", "asking", "answers", "taken") if f'"{name}"' in r[1] for x in left(few, f"{tmp_path}/state", name, r[0])]
    assert set(rest) <= {"mend"}  # nothing waits but the rows that moved the watermark


def test_hex_forms(spark):
    """A decimal id is looked up as it is, in hex, and in hex with a leading 0; other ids only as they are."""
    rows = [(1, DAY, 4, "id:291 sub:001"), (2, DAY, 4, "id:a12 x"), (3, DAY, 4, "text id:7 x"), (4, DAY, 1, "id:5 x")]
    got = traffic.receipt_candidates(spark.createDataFrame(rows, RECEIPTS)).collect()
    assert sorted((r["receipt_id"], r["form"], r["message_id"]) for r in got) == [(1, 0, "291"), (1, 1, "123"), (1, 2, "0123"), (2, 0, "a12"), (3, 0, "7"), (3, 1, "7"), (3, 2, "07")]
