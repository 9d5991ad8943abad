"""Micro-batches of a live message stream: keyed state with timers, equal to ``traffic.micro_batch_assign`` of the log.

An instance's messages wait in its state until the watermark has passed them, so they are taken in order of time however
their files arrive. A batch closes, and is given out, when it has ``most`` messages or when the watermark reaches its
deadline, ``wait_ms`` after its first message; a later message opens the next one. Timers wake an instance for the first
waiting message and for the open batch's deadline, and there is work only where one is due.

State is what lies within the watermark's delay, one open batch, and a number per instance. The order of one instance is one
task's work in each trigger, as in any keyed state; instances are parallel. Messages behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from msgloom.streaming.state import FRAME, as_key, from_key, packed, unpacked

GIVEN = 100_000  # rows of a frame that is given out


class MicroBatcher(StatefulProcessor):
    """State of an instance: ``waiting`` messages, the ``open`` batch's messages, and how many batches it has ``closed``.

    Messages come and wait by the frame (:mod:`msgloom.streaming.state`), and are cut into batches as arrays. ``passed`` is
    the watermark up to which an instance's messages are taken: a frame can hold some that are behind it.
    """

    def __init__(self, most: int, wait_us: int, message: T.StructType):
        self.most, self.wait, self.message = most, wait_us, message

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", FRAME)
        self.open = handle.getListState("open", self.message)
        self.closed = handle.getValueState("closed", "n long, passed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = self.closed.get()[1] if self.closed.exists() else None
        first, new = [], []
        for frame in rows:
            for raw in frame["frame"]:
                own = unpacked([(raw,)])
                late = pc.less_equal(own["us"], passed) if passed is not None else None
                if late is not None and pc.any(late).as_py():
                    own = own.filter(pc.invert(late))
                    raw = packed(own)[0]
                if own.num_rows:
                    first.append(pc.min(own["us"]).as_py())
                    new.append((bytearray(raw),))
        if new:
            self.waiting.appendList(new)
            self._wake([min(first)], list(self.handle.listTimers()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        messages = unpacked(self.waiting.get())
        messages = messages.sort_by([("us", "ascending"), ("message_id", "ascending")]).combine_chunks() if messages else None
        due = int(np.searchsorted(messages["us"].to_numpy(), passed, "right")) if messages else 0
        rest = messages.slice(due) if messages else []
        before = [tuple(x) for x in self.open.get()]
        n = self.closed.get()[0] if self.closed.exists() else 0
        types = [to_arrow_type(x.dataType) for x in self.message]
        mine = pa.table([pa.array([x[k] for x in before], kind) for k, kind in enumerate(types)], ["us", "message_id"])
        mine = pa.concat_tables([mine, messages.slice(0, due)]) if due else mine
        us = mine["us"].to_numpy()
        after = np.minimum(np.arange(len(us)) + self.most, np.searchsorted(us, us + self.wait, "right")).tolist()  # where the next batch starts
        starts, at = [], 0
        while at < len(us):
            starts.append(at)
            at = after[at]
        if starts and at - starts[-1] < self.most and us[starts[-1]] + self.wait > passed:
            at = starts.pop()  # still open
        if len(rest):
            self.waiting.put([packed(rest)])
        elif messages:
            self.waiting.clear()
        still = [tuple(x.values()) for x in mine.slice(at).to_pylist()]
        if still:
            self.open.put(still)
        elif before:
            self.open.clear()
        self.closed.update((n + len(starts), passed))
        self._wake([int(x) for x in (*(rest["us"][:1].to_pylist() if len(rest) else ()), *(x[0] + self.wait for x in still[:1]))], list(self.handle.listTimers()), again=True)
        batch = n + np.repeat(np.arange(len(starts)), np.diff(np.append(starts, at)).astype(np.int64)) if starts else np.zeros(0, np.int64)
        for start in range(0, at, GIVEN):
            part = mine["message_id"].slice(start, min(GIVEN, at - start)).to_pandas(integer_object_nulls=True)
            yield pd.DataFrame({"key": pd.Series([str(key[0])] * len(part), dtype=object), "message_id": part.astype(object), "batch": batch[start : start + len(part)]})

    def _wake(self, times: list[int], timers: list[int], again: bool = False) -> None:
        """One timer, at the first of ``times`` that the watermark has to pass; a timer before it stays unless it is set ``again``."""
        due = min((-(-x // 1000) for x in times), default=None)
        if not again and timers and due is not None:
            due = min(due, *timers)
        for at in timers:
            if at != due:
                self.handle.deleteTimer(at)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The messages of a batch as a frame for each instance, with the time of the last: rows of keyed state cost far more than arrays."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by("key").combine_chunks()
        if not len(rows):
            continue
        ends = pc.run_end_encode(rows["key"].combine_chunks())
        keys, stops = ends.values, ends.run_ends.to_numpy()
        own = [rows.select(["us", "message_id"]).slice(a, b - a) for a, b in zip(np.append(0, stops[:-1]), stops)]
        yield pa.RecordBatch.from_arrays([keys, pa.array([pc.max(x["us"]).as_py() for x in own]), pa.array([bytes(packed(x)[0]) for x in own])], ["key", "us", "frame"])


def micro_batches(messages: DataFrame, most: int = 64, wait_ms: float = 50.0, late: str = "10 minutes") -> DataFrame:
    """``instance, message_id, batch`` of a stream ``instance, message_id, ts``, given out when a batch closes."""
    message = T.StructType([T.StructField("us", T.LongType()), T.StructField("message_id", messages.schema["message_id"].dataType)])
    given = T.StructType([T.StructField("key", T.StringType()), message["message_id"], T.StructField("batch", T.LongType())])
    batcher = MicroBatcher(most, int(wait_ms * 1000), message)
    rows = messages.filter("ts is not null").select(as_key("instance").alias("key"), F.unix_micros("ts").alias("us"), "message_id")
    frames = rows.mapInArrow(_frames, "key string, us long, frame binary").select("key", F.timestamp_micros("us").alias("ts"), "frame").withWatermark("ts", late)
    out = frames.groupBy("key").transformWithStateInPandas(statefulProcessor=batcher, outputStructType=given, outputMode="Append", timeMode="eventTime")
    return out.select(from_key("key", messages.schema["instance"].dataType).alias("instance"), "message_id", "batch")
