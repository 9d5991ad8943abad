"""Writers of datasets, audit entries, predictions, summaries and feedback."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.operators.audit import apply_retention


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """``text, label`` as Parquet, or as quoted CSV with a header."""
    out = df.select("text", "label").write.mode("overwrite")
    out.parquet(path) if fmt == "parquet" else out.options(header=True, quoteAll=True, escape='"').csv(path)


#: Bytes of an audit file.
MOST_BYTES = 100 << 20


def write_audit(df: DataFrame, path: str, most_bytes: int = MOST_BYTES) -> None:
    """Appended JSON lines, ``date=``/``part=`` folders of one file each, none over ``most_bytes`` (but a single longer line)."""
    lines = df.select(F.to_date("timestamp").alias("date"), F.to_json(F.struct(*df.columns)).alias("value"))
    _write_lines(lines.repartitionByRange("date", F.xxhash64("value")), path, most_bytes)


def _write_lines(lines: DataFrame, path: str, most_bytes: int) -> None:
    """Each task fills a day's files in turn by the bytes of its lines; a task that is run again gives them the same names."""
    run = uuid.uuid4().hex[:12]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, filled = TaskContext.get().partitionId(), {}
        for batch in batches:
            sizes = (pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False) + 1).tolist()
            names = []
            for day, size in zip(batch.column("date").to_pylist(), sizes):
                part, used = filled.get(day, (0, 0))
                if used and used + size > most_bytes:
                    part, used = part + 1, 0
                filled[day] = part, used + size
                names.append(f"{run}-{task}-{part}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], [*batch.schema.names, "part"])

    lines.mapInArrow(cut, "date date, value string, part string").write.mode("append").partitionBy("date", "part").text(path)


def compact_audit(spark: SparkSession, path: str, day: date, most_bytes: int = MOST_BYTES) -> None:
    """The files of a day that are not half full, written anew as few full ones.

    New files come first, then the old ones go; a run that is cut short between leaves lines twice, which have one ``event_id``.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date={day.isoformat()}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    small = [x.getPath() for x in files.listStatus(folder) if 2 * files.getContentSummary(x.getPath()).getLength() < most_bytes]
    if len(small) < 2:
        return
    lines = spark.read.text([str(x) for x in small]).select(F.lit(day).alias("date"), "value")
    whole = sum(files.getContentSummary(x).getLength() for x in small)
    _write_lines(lines.coalesce(max(1, whole // most_bytes)), path, most_bytes)
    for x in small:
        files.delete(x, True)


def write_predictions(df: DataFrame, path: str) -> None:
    df.withColumn("conf", F.bround("conf", 4)).write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON document per dataset."""
    summary.select(F.to_json(F.struct(*summary.columns)).alias("value")).write.mode("overwrite").text(path)


def write_feedback(df: DataFrame, path: str) -> None:
    """Feedback appended in a folder per model; users without a name are anonymous."""
    yes = lambda c: F.when(F.col(c), "Yes").otherwise("No").alias({"thumbs_up": "ThumbsUp", "thumbs_down": "ThumbsDown"}[c])
    rows = df.select(F.col("feedback_id").alias("FeedbackID"), F.col("timestamp").cast("string").alias("Timestamp"), F.coalesce("user_id", F.lit("anonymous")).alias("UserID"), F.col("content").alias("Content"), F.col("feedback").alias("Feedback"), yes("thumbs_up"), yes("thumbs_down"), F.col("model").alias("Model"), F.col("model").alias("for_model"))
    rows.write.mode("append").partitionBy("for_model").options(header=True, escape='"').csv(path)


def export_feedback(spark, path: str, model: str) -> DataFrame:
    """One model's feedback; only its folder is read."""
    return spark.read.options(header=True, escape='"').csv(path).filter(F.col("for_model") == model).drop("for_model")


def archive_audit(df: DataFrame, now: Column, kept: str, archive: str | None = None, days: int = 90) -> None:
    """Write the entries to keep, and older ones to ``archive`` (none: they go)."""
    keep, old = apply_retention(df, now, days)
    write_audit(keep, kept)
    if archive is not None:
        write_audit(old, archive)
