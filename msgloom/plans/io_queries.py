"""Registered round trips of readers and writers (S1-S12, K1-K6): the test tables written in each format and read back."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from msgloom.operators.evaluate import summary
from msgloom.plans import eval_queries as Q
from msgloom.plans import views as V
from msgloom.plans.registry import query
from msgloom.sources import audit_store
from msgloom.sources import readers as S
from msgloom.sources import writers as K


def _path(spark) -> str:
    """A new folder where the session keeps checkpoints (shared by all executors), else in the warehouse."""
    return V.new_folder(spark)


_FLAT = r"trim(regexp_replace(text, '[\t\n\r]', ' ', 'g'))"


def _flat(spark, d):
    return V.labelled(spark, d).withColumn("text", F.trim(F.regexp_replace("text", r"[\t\n\r]", " ")))


@query("s01_read_labelled", f"WITH {V.LABELLED} SELECT {_FLAT} AS text, label FROM labelled")
def s01(spark, d):
    path = _path(spark)
    _flat(spark, d).select(F.concat_ws(",", "text", F.upper("label"))).write.text(path)
    return S.read_labelled(spark, path).select("text", "label")


@query("s02_read_eval_csv", f"WITH {V.LABELLED} SELECT {_FLAT} AS text, label AS gold, category, language FROM labelled")
def s02(spark, d):
    path = _path(spark)
    _flat(spark, d).select("text", "label", "category", "language").write.options(header=True, quoteAll=True, escape='"').csv(path)
    return S.read_eval_csv(spark, path)


@query("s03_read_generic_csv", f"WITH {V.LABELLED} SELECT {_FLAT} AS text, label AS gold FROM labelled WHERE row_id % 9 <> 0 AND {_FLAT} <> ''")
def s03(spark, d):
    path = _path(spark)
    _flat(spark, d).select("text", F.when(F.col("row_id") % 9 == 0, "odd").otherwise(F.col("label")).alias("label")).write.options(header=True, quoteAll=True, escape='"').csv(path)
    return S.read_generic_csv(spark, path).select("text", "gold")


@query("s04_read_uci_tsv", f"WITH {V.LABELLED} SELECT {_FLAT} AS text, label AS gold, 'uci' AS category FROM labelled")
def s04(spark, d):
    path = _path(spark)
    _flat(spark, d).select(F.concat_ws("\t", "label", "text")).write.text(path)
    return S.read_uci_tsv(spark, path).select("text", "gold", "category")


@query("s05_read_imc25", f"WITH {V.LABELLED} SELECT {_FLAT} AS text, CASE WHEN label = 'spam' THEN 'spam' ELSE 'phishing' END AS gold, language FROM labelled WHERE label <> 'ham' AND {_FLAT} <> ''")
def s05(spark, d):
    path = _path(spark)
    _flat(spark, d).select("text", F.when(F.col("label") != "ham", F.col("label")).alias("scam_type"), "language").write.options(header=True, quoteAll=True, escape='"').csv(path)
    return S.read_imc25(spark, path).select("text", "gold", "language")


@query("s06_read_mishra", f"WITH {V.LABELLED} SELECT {_FLAT} AS text, label AS gold FROM labelled WHERE label <> 'ham'")
def s06(spark, d):
    path = _path(spark)
    label = F.when(F.col("label") == "phishing", "Smishing").when(F.col("label") == "spam", "Spam").otherwise("other")
    _flat(spark, d).select(label.alias("LABEL"), F.col("text").alias("TEXT")).write.options(header=True, quoteAll=True, escape='"').csv(path)
    return S.read_mishra(spark, path).select("text", "gold")


@query("s07_read_samples_json", "SELECT text, item_id::VARCHAR AS gold FROM benchmark")
def s07(spark, d):
    """Each category of the benchmark table as one document of samples."""
    path = _path(spark)
    b = V.table(spark, d, "benchmark")
    sample = F.struct(F.col("item_id").cast("string").alias("id"), "text", F.col("item_id").cast("string").alias("ground_truth"))
    b.groupBy((F.col("item_id") % 4).alias("k")).agg(F.collect_list(sample).alias("samples")).select("samples").repartition(4).write.json(path)
    return S.read_samples_json(spark, path).select("text", "gold")


@query("s08_read_indonesian", f"WITH {V.LABELLED} SELECT {_FLAT} AS text, label FROM labelled WHERE {_FLAT} <> ''")
def s08(spark, d):
    path = _path(spark)
    label = F.when(F.col("label") == "ham", "Normal").when(F.col("label") == "phishing", "fraud").otherwise("SPAM")
    _flat(spark, d).select(label.alias("Kategori"), F.col("text").alias("Pesan")).write.options(header=True, quoteAll=True, escape='"').csv(path)
    return S.read_indonesian(spark, path)


@query("s09_union_datasets", f"WITH {V.LABELLED} SELECT text, label FROM labelled WHERE trim(text) <> '' UNION ALL SELECT text, label FROM labelled WHERE trim(text) <> ''")
def s09(spark, d):
    x = V.labelled(spark, d)
    return S.union_datasets(x, x.select(F.col("text").alias("Pesan"), F.upper("label").alias("Kategori")), x.select("row_id"))


@query("s10_read_with_fallback", f"WITH {V.MESSAGES} SELECT {_FLAT} AS line FROM messages WHERE {_FLAT} <> ''")
def s10(spark, d):
    path = _path(spark)
    m = V.messages(spark, d).select(F.trim(F.regexp_replace("text", r"[\t\n\r]", " ")).alias("value")).filter("value <> ''")
    m.write.text(path)
    return S.read_with_fallback(spark, path).select("line")


@query("s01_file_order", f"WITH {V.LABELLED}, x AS (SELECT row_id, text, label, row_id % 7 <> 0 AS second FROM labelled) SELECT row_number() OVER (ORDER BY second, row_id) - 1 AS row_id, row_id AS original, label FROM x")
def s01_order(spark, d):
    """A small file and a larger one behind it: row numbers go by path, then by line."""
    path = _path(spark)
    x = V.labelled(spark, d).select("row_id", F.concat_ws(",", F.col("row_id").cast("string"), "label").alias("value"), (F.col("row_id") % 7 == 0).alias("small"))
    for name, part in (("a", x.filter("small")), ("b", x.filter("not small"))):
        part.coalesce(1).sortWithinPartitions("row_id").select("value").write.text(f"{path}/{name}")
    return S.read_labelled(spark, f"{path}/*").select("row_id", F.col("text").cast("long").alias("original"), "label")


@query("s11_read_audit", f"WITH {V.AUDIT} SELECT event_id AS number, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS at, entry_type, client_ip, label, confidence FROM audit")
def s11(spark, d):
    return V.logged(spark, d).select("number", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "entry_type", "client_ip", "label", "confidence")


@query("s11_malformed", "SELECT 2::BIGINT AS malformed, count(*) AS entries FROM events")
def s11_malformed(spark, d):
    log = S.read_audit(spark, V.write_log(spark, d))
    return S.malformed(log).crossJoin(log.filter("_corrupt_record is null").agg(F.count("event_id").alias("entries")))


@query("a09_catalog_files", f"""WITH {V.LABELLED} SELECT 'a' AS dataset, 'text,label' AS columns, count(*) AS rows, (SELECT string_agg(label || '=' || n, ',' ORDER BY label || '=' || n) FROM (SELECT label, count(*) AS n FROM labelled GROUP BY label)) AS labels FROM labelled
  UNION ALL SELECT 'b', 'row_id,category', count(*), '' FROM labelled WHERE row_id % 3 = 0""")
def a09_files(spark, d):
    path = _path(spark)
    x = V.labelled(spark, d).coalesce(1)
    x.select("text", "label").write.options(header=True, escape='"').csv(f"{path}/a")
    x.filter("row_id % 3 = 0").select("row_id", "category").write.options(header=True).csv(f"{path}/b")
    return S.catalog_files(spark, f"{path}/*/*.csv").select(F.regexp_extract("dataset", r"/(\w)/[^/]*$", 1).alias("dataset"), "columns", "rows", "labels")


_FEEDBACK = f"WITH {V.AUDIT} SELECT feedback_id, 'anonymous' AS user_id, thumbs_up, thumbs_down, model FROM audit WHERE entry_type = 'feedback'"


def _feedback(spark, d):
    return V.audit(spark, d).filter("entry_type = 'feedback'").select("feedback_id", "timestamp", F.lit(None).cast("string").alias("user_id"), F.lit("text").alias("content"), F.lit("fine").alias("feedback"), "thumbs_up", "thumbs_down", "model")


@query("s12_read_feedback", _FEEDBACK)
def s12(spark, d):
    path = _path(spark)
    K.write_feedback(_feedback(spark, d), path)
    return S.read_feedback(spark, path + "/*").select("feedback_id", "user_id", "thumbs_up", "thumbs_down", "model")


@query("k01_write_dataset", f"WITH {V.LABELLED} SELECT text, label FROM labelled")
def k01(spark, d):
    path = _path(spark)
    K.write_dataset(V.labelled(spark, d), path)
    return spark.read.parquet(path)


@query("k02_write_audit", f"WITH {V.AUDIT} SELECT strftime(timestamp, '%Y-%m-%d') AS date, event_id, entry_type, client_ip, label FROM audit")
def k02(spark, d):
    path = _path(spark)
    K.write_audit(V.audit(spark, d), path, 100_000)
    return spark.read.schema("event_id long, entry_type string, client_ip string, label string, date string").json(path).drop("part")


@query("k03_write_predictions", f"{Q._LB} SELECT row_id, pred, round_even(conf, 4) AS conf FROM p2")
def k03(spark, d):
    path = _path(spark)
    K.write_predictions(Q.predictions(spark, d, "v2").select("row_id", "pred", "conf"), path)
    return spark.read.schema("row_id long, pred string, conf double").json(path)


@query("k04_write_summary", f"{Q._LB} SELECT category AS dataset, count(*) AS n, {Q._ACC} AS acc FROM p2 GROUP BY category")
def k04(spark, d):
    path = _path(spark)
    K.write_summary(summary(Q.predictions(spark, d, "v2").withColumnRenamed("category", "dataset")), path)
    return spark.read.schema("dataset string, n long, acc double").json(path)


@query("k05_export_feedback", f"SELECT feedback_id, thumbs_up FROM ({_FEEDBACK}) WHERE model = 'model-a'")
def k05(spark, d):
    path = _path(spark)
    K.write_feedback(_feedback(spark, d), path)
    return K.export_feedback(spark, path, "model-a").select(F.col("FeedbackID").alias("feedback_id"), (F.col("ThumbsUp") == "Yes").alias("thumbs_up"))


@query("k06_apply_retention", f"WITH {V.AUDIT} SELECT event_id AS number, timestamp < '2024-01-21'::TIMESTAMP AS old FROM audit")
def k06(spark, d):
    """Entries left in the store, and those in the archive."""
    path, archive = V.stored(spark, d), V.new_folder(spark)
    audit_store.retain(spark, path, datetime(2024, 1, 31, tzinfo=UTC), 10, archive)
    return spark.read.parquet(path).select("number", F.lit(False).alias("old")).unionByName(spark.read.parquet(archive).select("number", F.lit(True).alias("old")))
