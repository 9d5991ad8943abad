"""Readers of labelled sets, benchmark sets, audit logs and feedback. All are Spark sources; nothing is read on the driver."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from msgloom.operators.audit import AUDIT_SCHEMA, audit_rows
from msgloom.operators.quality import LABELS
from msgloom.operators.sampling import with_few

EVAL_COLUMNS = ["text", "gold", "category", "language"]


#: Columns of :func:`_placed`.
_PLACE = ["_file", "_block", "_place"]


def _placed(df: DataFrame) -> DataFrame:
    """Rows of a file source with where each stands: its file, the start of the split, and the row in it."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))


def _numbered(df: DataFrame) -> DataFrame:
    """Rows of :func:`_placed` with ``row_id`` in file order: files by path, lines by place.

    Splits are few, so their numbers come from a window over one row a split; rows keep their place in it.
    """
    splits = df.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("_file").alias("_f"), F.col("_block").alias("_s"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_place")) - 1
    rows = df.withColumn("_rank", rank).join(splits, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_s")))
    return rows.withColumn("row_id", (F.col("_before") + F.col("_rank")).cast("long")).drop(*_PLACE, "_f", "_s", "_first", "_before", "_rank")


def _csv(spark: SparkSession, path: str | list[str], multi_line: bool = True, **options) -> DataFrame:
    """``multi_line`` allows line breaks inside quotes, for which a file must be read by one task."""
    return spark.read.options(header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE", **options).csv(path)


def _empty_if_missing(df: DataFrame, name: str) -> Column:
    found = next((c for c in df.columns if c.lower() == name.lower()), None)
    return F.coalesce(F.col(f"`{found}`").cast("string"), F.lit("")) if found else F.lit("")


def read_labelled(spark: SparkSession, path: str, dialect: str = "lastcomma", multi_line: bool = True) -> DataFrame:
    """``row_id, text, label`` in file order. ``lastcomma`` splits lines at their last comma by hand, keeps quotes and drops labels that are not valid; ``csv`` reads quoted fields and keeps all rows.

    Bytes that are not UTF-8 disappear. Line breaks inside quotes need ``multi_line``; without it, large files are split.
    """
    if dialect == "csv":
        df = _csv(spark, path, multi_line)
        text, label = _dropped(_empty_if_missing(df, "text")), F.lower(F.trim(_empty_if_missing(df, "label")))
        return _numbered(_placed(df).select(text.alias("text"), label.alias("label"), *_PLACE)).select("row_id", "text", "label")
    lines = _numbered(_placed(spark.read.text(path))).withColumn("value", _dropped(F.col("value")))
    parts = lines.select("row_id", F.trim(F.regexp_extract("value", r"^(.*),([^,]*)$", 1)).alias("text"), F.lower(F.trim(F.regexp_extract("value", r"^(.*),([^,]*)$", 2))).alias("label"))
    return parts.filter(F.col("label").isin(LABELS)).select("row_id", "text", "label")


def _dropped(c: Column) -> Column:
    return F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit(""))


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    return df.select(_empty_if_missing(df, "text").alias("text"), _empty_if_missing(df, "label").alias("gold"), _empty_if_missing(df, "category").alias("category"), _empty_if_missing(df, "language").alias("language"))


def read_generic_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a text and a valid label."""
    return read_eval_csv(spark, path).filter((F.col("text") != "") & F.col("gold").isin(LABELS))


def read_uci_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Label, tab, text; blank lines and headers are skipped, and only the first tab splits."""
    parts = spark.read.text(path).filter(F.trim("value") != "").select(F.split("value", "\t", 2).alias("p")).filter(F.size("p") == 2)
    x = parts.select(F.trim(F.get("p", 1)).alias("text"), F.lower(F.trim(F.get("p", 0))).alias("gold"))
    return x.filter(F.col("gold").isin(LABELS)).select("text", "gold", F.lit("uci").alias("category"), F.lit("en").alias("language"))


def read_imc25(spark: SparkSession, path: str) -> DataFrame:
    """Attacks only: ``scam_type`` spam is spam and any other phishing; rows without one or without text are left out (see :func:`skipped`)."""
    df = _csv(spark, path)
    kind, text = F.trim(_empty_if_missing(df, "scam_type")), F.trim(_empty_if_missing(df, "text"))
    language = F.when(_empty_if_missing(df, "language") == "", "unknown").otherwise(_empty_if_missing(df, "language"))
    return df.filter((text != "") & (kind != "")).select(text.alias("text"), F.when(F.lower(kind) == "spam", "spam").otherwise("phishing").alias("gold"), kind.alias("category"), language.alias("language"))


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """How many rows with text :func:`read_imc25` leaves out for want of a type."""
    df = _csv(spark, path)
    return df.agg(F.count_if((F.trim(_empty_if_missing(df, "text")) != "") & (F.trim(_empty_if_missing(df, "scam_type")) == "")).alias("skipped"))


MISHRA = {"ham": "ham", "spam": "spam", "Spam": "spam", "Smishing": "phishing", "smishing": "phishing"}


def read_mishra(spark: SparkSession, path: str) -> DataFrame:
    """Rows of known labels; bad bytes are replaced."""
    df = _csv(spark, path)
    table = F.create_map(*(F.lit(x) for pair in MISHRA.items() for x in pair))
    x = df.select(_empty_if_missing(df, "TEXT").alias("text"), F.try_element_at(table, F.trim(_empty_if_missing(df, "LABEL"))).alias("gold"))
    return x.filter("gold is not null").select("text", "gold", F.lit("mishra").alias("category"), F.lit("en").alias("language"))


def read_samples_json(spark: SparkSession, path: str) -> DataFrame:
    """One document with ``samples``, a row each."""
    df = spark.read.schema("samples array<struct<id:string,text:string,ground_truth:string,language:string,category:string>>").option("multiLine", True).json(path)
    return df.select(F.explode("samples").alias("s")).select("s.text", F.col("s.ground_truth").alias("gold"), "s.category", "s.language")


INDONESIAN = {"ham": "ham", "normal": "ham", "legitimate": "ham", "spam": "spam", "phishing": "phishing", "fraud": "phishing"}


def read_indonesian(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    table = F.create_map(*(F.lit(x) for pair in INDONESIAN.items() for x in pair))
    x = df.select(F.trim(_empty_if_missing(df, "Pesan")).alias("text"), F.try_element_at(table, F.lower(F.trim(_empty_if_missing(df, "Kategori")))).alias("label"))
    return x.filter((F.col("text") != "") & F.col("label").isNotNull())


def union_datasets(*parts: DataFrame) -> DataFrame:
    """All parts with a text and a label column, by either name; blank texts and labels that are not valid are dropped, and parts without the columns skipped."""
    found = []
    for df in parts:
        text = next((c for c in df.columns if c in ("text", "Pesan")), None)
        label = next((c for c in df.columns if c in ("label", "Kategori")), None)
        if text and label:
            found.append(df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.lower(F.trim(label)).alias("label")))
    if not found:
        raise ValueError("no dataset has a text and a label column")
    x = reduce(DataFrame.unionByName, found)
    return x.filter((F.trim("text") != "") & F.col("label").isin(LABELS))


def catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with their sizes: ``dataset`` (the path), ``size_mb, columns, rows, labels`` (counts by label, if there is such a column).

    Only one row a file comes to the driver: its header, by which files are read together.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("dataset"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("place"))
    heads = lines.groupBy("dataset").agg(F.min_by("value", F.struct("block", "place")).alias("columns"), F.bround(F.max("bytes") / (1 << 20), 2).alias("size_mb"))
    files: dict[str, list[str]] = {}
    for r in heads.select("dataset", "columns").collect():
        files.setdefault(r["columns"], []).append(r["dataset"])
    counts = spark.createDataFrame([], "dataset string, label string, n long")
    for own in files.values():
        df = _csv(spark, own)
        label = next((F.col(f"`{c}`").cast("string") for c in df.columns if c == "label"), F.lit(None).cast("string"))
        counts = counts.unionByName(df.select(F.col("_metadata.file_path").alias("dataset"), label.alias("label")).groupBy("dataset", "label").agg(F.count("*").alias("n")))
    named = F.when(F.col("label").isNotNull(), F.concat_ws("=", "label", F.col("n").cast("string")))
    per = counts.groupBy("dataset").agg(F.sum("n").alias("rows"), F.array_join(F.array_sort(F.collect_list(named)), ",").alias("labels"))
    return heads.join(per, "dataset", "left").select("dataset", "size_mb", "columns", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("labels", F.lit("")).alias("labels"))


def read_with_fallback(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (``path, at, line``), each file in UTF-8 if it is valid, else in Latin-1; ``at`` counts empty lines, too.

    No character's bytes hold a line feed, in either charset, so a file is valid where all its lines are: splits of a file
    are judged apart, joined a file, and each line is then decoded by its file's charset. Only one line is ever whole.
    """
    rows = _placed(spark.read.option("lineSep", "\n").text(path)).withColumn("path", F.col("_file"))
    rows = _numbered(rows.withColumn("value", F.col("value").cast("binary")))
    files = rows.groupBy(F.col("path").alias("_path")).agg(F.min("row_id").alias("_first"), F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))).alias("_utf8"))
    rows = with_few(rows, files, F.col("path") == F.col("_path"))
    text = F.when(F.col("_utf8"), F.col("value").cast("string")).otherwise(F.decode("value", "ISO-8859-1"))
    return rows.select("path", (F.col("row_id") - F.col("_first")).alias("at"), F.regexp_replace(text, r"\r$", "").alias("line")).filter("line <> ''")


def read_audit(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Audit entries of JSON lines files, with times and ids as :func:`msgloom.operators.audit.audit_rows` gives them.

    A line that is no JSON has only ``_corrupt_record`` and an id.
    """
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(AUDIT_SCHEMA + ", _corrupt_record STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return audit_rows(rows.drop("date", "part"))  # the folders are no part of an entry, nor of its id


def malformed(audit: DataFrame) -> DataFrame:
    """How many lines were no JSON."""
    return audit.agg(F.count(F.when(F.col("event_id").isNotNull(), F.col("_corrupt_record"))).alias("malformed"))  # Spark reads no broken lines without another column


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    yes = lambda c: _empty_if_missing(df, c) == "Yes"
    return df.select(F.col("FeedbackID").alias("feedback_id"), F.try_to_timestamp("Timestamp").alias("timestamp"), F.col("UserID").alias("user_id"), F.col("Content").alias("content"), F.col("Feedback").alias("feedback"), yes("ThumbsUp").alias("thumbs_up"), yes("ThumbsDown").alias("thumbs_down"), F.col("Model").alias("model"))


#: Benchmark readers by name; callers may add their own.
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"eval": read_eval_csv, "generic": read_generic_csv, "uci": read_uci_tsv, "imc25": read_imc25, "mishra": read_mishra, "samples": read_samples_json}


def read_benchmarks(spark: SparkSession, sets: dict[str, tuple[str, str]]) -> DataFrame:
    """Several benchmark sets, name -> (loader, path), as one table with ``dataset``."""
    return reduce(DataFrame.unionByName, [LOADERS[loader](spark, path).select(F.lit(name).alias("dataset"), *EVAL_COLUMNS) for name, (loader, path) in sets.items()])
