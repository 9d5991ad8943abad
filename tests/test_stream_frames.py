"""Keyed state that is read and written by the frame."""

from msgloom.streaming import batcher
from msgloom.streaming.state import rocksdb
from tests.test_stateful_streams import at, few  # noqa: F401


def test_messages_wait_by_the_frame(few, tmp_path):
    """Keyed state gets a row for a frame, not for a message; messages behind the watermark are dropped from their frame."""
    rows = [(k % 2, k, at(1000 * k)) for k in range(4000)]
    late = [(0, 10**6, at(5)), (1, 10**6 + 1, at(4_500_000))]  # one behind, one ahead of what is taken by then
    schema = "instance int, message_id long, ts timestamp"
    for part in (rows, [(9, 10**7, at(10**9))], late + [(0, 10**6 + 2, at(10**9 + 1)), (9, 10**7 + 1, at(10**11))], [(9, 10**7 + 2, at(10**11 + 1))]):
        few.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = few.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = batcher.micro_batches(stream, 8, 50.0, "1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    with rocksdb(few):
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
    updated = [x["numInputRows"] for x in query.recentProgress]
    assert sum(updated) == 4000 + 1 + 4 + 1
    states = [s["numRowsUpdated"] for x in query.recentProgress for s in x["stateOperators"]]
    assert max(states) < 100
    got = {r["message_id"] for r in few.read.parquet(f"{tmp_path}/out").collect()}
    assert set(range(4000)) <= got and 10**6 not in got and 10**6 + 2 in got
