"""Structured Streaming forms: the batch functions over unbounded tables, with watermarks where state must end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from msgloom.operators import audit, scoring, traffic


def minute_counters(actions: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Policy counters of every minute (``ts, action``)."""
    return traffic.stats_per_minute(actions.withWatermark("ts", late))


def rolling_counts(batches: DataFrame, span: str = "60 seconds", step: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Messages of each instance in sliding windows."""
    x = batches.withWatermark("ts", late).groupBy(F.window("ts", span, step).alias("w"), "instance").agg(F.sum("size").alias("messages"))
    return x.select(F.col("w.start").alias("start"), "instance", "messages")


def classify_stream(messages: DataFrame, rules: DataFrame, threshold: float = scoring.THRESHOLD, scorer: Callable | None = None) -> DataFrame:
    """Messages (``text``, ``unclassifiable``, ``error``) scored and run through the policy.

    Any scorer of :func:`scoring.score_messages` will do; none is the rule scorer. A row that it fails on is forwarded as an
    error, and the others of its batch are scored.
    """
    scored = scoring.score_messages(messages, scorer, guarded=True) if scorer else scoring.rule_scorer(messages)
    return scoring.apply_policy(scored.withColumnRenamed("pred", "label"), rules, threshold)


def write_by_action(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """One folder per action and batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("action").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def client_sessions(stream: DataFrame, gap: str = "120 seconds", late: str = "5 minutes") -> DataFrame:
    return traffic.client_sessions(stream.withWatermark("ts", late), gap)


def audit_stats(rows: DataFrame, span: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Running counts, mean confidence and about how many clients, by window, label and model; windows end ``late`` after their time.

    ``sketch`` can be united over windows and with the batch's (:func:`audit.clients_between`).
    """
    x = rows.withWatermark("ts", late).groupBy(F.window("ts", span).alias("w"), "label", "model").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), audit.clients_of(F.col("client_ip")).alias("sketch"))
    return x.select(F.col("w.start").alias("start"), "label", "model", "n", "avg_confidence", F.hll_sketch_estimate("sketch").alias("clients"), "sketch")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, once."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
