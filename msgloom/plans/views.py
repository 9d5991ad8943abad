"""Views over the test tables, in Spark and in SQL, that the registered queries read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.functions.text import hash_number


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer splits than there are cores is dealt out to all of them: its texts cost more than the move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def messages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("language"), F.col("source").alias("category"))


MESSAGES = "messages AS (SELECT doc_id AS row_id, text, lang AS language, source AS category FROM documents)"

_LINK = " Urgent: verify account https://bit.ly/Q1 or http://192.168.0.1/bank-login now!!"
_REACH = "  😀😀 call 555-123-4567, 4155550100123 or bob@example.com"


def noisy(spark: SparkSession, d: str) -> DataFrame:
    """Messages, most of them with links, look-alike letters, invisible characters or personal data put in by row number."""
    t, r = F.col("text"), F.col("row_id") % 5
    text = F.when(r == 0, F.concat(t, F.lit(_LINK))).when(r == 1, F.translate(t, "aeo", "аео")).when(r == 2, F.concat(F.lit("V​e­r café "), t)).when(r == 3, F.concat(t, F.lit(_REACH))).otherwise(t)
    return messages(spark, d).withColumn("text", text)


NOISY = f"""{MESSAGES}, noisy AS (SELECT row_id, language, category, CASE row_id % 5 WHEN 0 THEN text || '{_LINK}' WHEN 1 THEN translate(text, 'aeo', 'аео')
  WHEN 2 THEN 'V' || chr(8203) || 'e' || chr(173) || 'r cafe' || chr(769) || ' ' || text WHEN 3 THEN text || '{_REACH}' ELSE text END AS text FROM messages)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "phishing").when(F.col("quality") == 0, "spam").otherwise("ham")
    return messages(spark, d).join(table(spark, d, "labels").withColumnRenamed("doc_id", "row_id"), "row_id").select("row_id", "text", "language", "category", label.alias("label"))


LABELLED = f"""{MESSAGES}, labelled AS (SELECT m.row_id, text, language, category, CASE WHEN toxic = 1 THEN 'phishing' WHEN quality = 0 THEN 'spam' ELSE 'ham' END AS label
  FROM messages m JOIN labels l ON m.row_id = l.doc_id)"""


def strata(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows, some of them without a label or a language, and a rare label."""
    r = F.col("row_id")
    return labelled(spark, d).withColumns({"label": F.when(r % 101 == 3, "other").when(r % 17 != 0, F.col("label")), "language": F.when(r % 13 != 0, F.col("language"))})


STRATA = f"""{LABELLED}, strata AS (SELECT row_id, text, category, CASE WHEN row_id % 13 <> 0 THEN language END AS language,
  CASE WHEN row_id % 101 = 3 THEN 'other' WHEN row_id % 17 <> 0 THEN label END AS label FROM labelled)"""

LABELS = ["ham", "spam", "phishing"]


def logits(spark: SparkSession, d: str, version: str) -> DataFrame:
    """Labelled rows with three pseudo-random logits; version 2 leans to the true label."""
    lean = [F.when((F.col("label") == x) & F.lit(version == "v2"), 0.5).otherwise(0.0) for x in LABELS]
    values = [hash_number(F.col("row_id"), version, str(k)) / float(1 << 32) + lean[k] for k in range(3)]
    return labelled(spark, d).select("row_id", "text", F.col("label").alias("gold"), "category", "language", F.array(*values).alias("logits"))


def logits_sql(version: str) -> str:
    one = lambda k: f"(('0x' || substr(md5(row_id || '|{version}|{k}'), 1, 8))::BIGINT / 4294967296.0" + (f" + CASE WHEN label = '{LABELS[k]}' THEN 0.5 ELSE 0 END)" if version == "v2" else ")")
    return f"SELECT row_id, text, label AS gold, category, language, [{one(0)}, {one(1)}, {one(2)}] AS logits FROM labelled"


def predictions_sql(version: str) -> str:
    """Row per message: gold, pred, conf (the softmax at the first largest logit)."""
    return f"""(SELECT row_id, text, gold, category, language, ['ham', 'spam', 'phishing'][list_position(logits, list_max(logits))] AS pred,
      exp(list_max(logits)) / list_sum(list_transform(logits, lambda x: exp(x))) AS conf FROM ({logits_sql(version)}))"""


def audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type").isin("view", "click"), "prediction").when(F.col("event_type") == "purchase", "feedback").when(F.col("event_type") == "error", "access_denied").otherwise("system_event")
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int"))
    only = lambda k, c: F.when(kind == k, c)
    return e.select(
        "event_id", F.col("ts").alias("timestamp"), kind.alias("entry_type"), F.when(kind == "system_event", "system").otherwise(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))).alias("client_ip"),
        only("prediction", pick("ham", "spam", "phishing")).alias("label"), only("prediction", F.least(F.col("value") / 500, F.lit(1.0))).alias("confidence"),
        F.when(kind.isin("prediction", "feedback"), pick("model-a", "model-b")).alias("model"),
        only("feedback", F.concat(F.lit("fb-"), F.col("event_id").cast("string"))).alias("feedback_id"), only("feedback", F.col("event_id") % 3 == 0).alias("thumbs_up"), only("feedback", F.col("event_id") % 3 == 1).alias("thumbs_down"),
        only("access_denied", F.lit("/predict")).alias("endpoint"), only("access_denied", pick("blocked address", "no key")).alias("reason"),
        only("system_event", pick("startup", "shutdown", "load_error", "reload")).alias("event_type"), only("system_event", pick("", "done")).alias("message"),
        only("system_event", F.create_map(F.lit("user"), F.col("user_id").cast("string"))).alias("metadata"),
    )


def new_folder(spark: SparkSession) -> str:
    """A new folder where the session keeps checkpoints (shared by all executors), else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/io-{uuid.uuid4().hex}"


def write_log(spark: SparkSession, d: str) -> str:
    """The audit entries as a service logs them: JSON lines with times whose zone is written twice, and two broken lines.

    ``text_hash`` carries the number of the entry, by which a test can tell entries apart.
    """
    path = new_folder(spark)
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00Z'")
    entry = audit(spark, d).withColumns({"timestamp": stamp, "text_hash": F.concat(F.lit("sha256:"), F.col("event_id").cast("string"))}).drop("event_id")
    lines = entry.select(F.to_json(F.struct(*entry.columns)).alias("value"))
    broken = spark.createDataFrame([("{\"timestamp\": \"2024-01-",), ("no json",)], "value string")
    lines.unionByName(broken).write.text(path)
    return path


def logged(spark: SparkSession, d: str) -> DataFrame:
    """The audit entries read back from a log, with their ``number``."""
    from msgloom.sources.readers import read_audit

    rows = read_audit(spark, write_log(spark, d)).filter("_corrupt_record is null")
    return rows.withColumn("number", F.substring("text_hash", 8, 20).cast("long"))


def stored(spark: SparkSession, d: str) -> str:
    """The path of an audit store that holds the log."""
    from msgloom.sources import audit_store

    path = new_folder(spark)
    audit_store.append(logged(spark, d), path)
    return path


_KIND = "CASE WHEN event_type IN ('view', 'click') THEN 'prediction' WHEN event_type = 'purchase' THEN 'feedback' WHEN event_type = 'error' THEN 'access_denied' ELSE 'system_event' END"


def _pick(*names: str) -> str:
    return f"{list(names)!r}[event_id % {len(names)} + 1]"


AUDIT = f"""raw_audit AS (SELECT *, {_KIND} AS entry_type FROM events), audit AS (SELECT event_id, ts AS timestamp, entry_type,
  CASE WHEN entry_type = 'system_event' THEN 'system' ELSE '10.0.0.' || user_id END AS client_ip,
  CASE WHEN entry_type = 'prediction' THEN {_pick('ham', 'spam', 'phishing')} END AS label,
  CASE WHEN entry_type = 'prediction' THEN least(value / 500, 1.0) END AS confidence,
  CASE WHEN entry_type IN ('prediction', 'feedback') THEN {_pick('model-a', 'model-b')} END AS model,
  CASE WHEN entry_type = 'feedback' THEN 'fb-' || event_id END AS feedback_id,
  CASE WHEN entry_type = 'feedback' THEN event_id % 3 = 0 END AS thumbs_up, CASE WHEN entry_type = 'feedback' THEN event_id % 3 = 1 END AS thumbs_down,
  CASE WHEN entry_type = 'access_denied' THEN '/predict' END AS endpoint, CASE WHEN entry_type = 'access_denied' THEN {_pick('blocked address', 'no key')} END AS reason,
  CASE WHEN entry_type = 'system_event' THEN {_pick('startup', 'shutdown', 'load_error', 'reload')} END AS event_type,
  CASE WHEN entry_type = 'system_event' THEN {_pick('', 'done')} END AS message, CASE WHEN entry_type = 'system_event' THEN user_id::VARCHAR END AS meta_user
  FROM raw_audit)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ok = F.col("event_type") != "error"
    return e.select(F.col("event_id").alias("request_index"), F.col("ts").cast("timestamp").alias("started"), (F.col("user_id") % 10).alias("scenario"), ok.alias("success"), F.when(ok, F.col("value")).alias("response_time"), F.when(ok, F.get(F.array(*map(F.lit, LABELS)), (F.col("event_id") % 3).cast("int"))).alias("label"), F.when(~ok, F.concat(F.lit("HTTP "), (500 + F.col("event_id") % 4).cast("string"))).alias("error"))


REQUESTS = """requests AS (SELECT event_id AS request_index, ts AS started, user_id % 10 AS scenario, event_type <> 'error' AS success, CASE WHEN event_type <> 'error' THEN value END AS response_time,
  CASE WHEN event_type <> 'error' THEN ['ham', 'spam', 'phishing'][event_id % 3 + 1] END AS label, CASE WHEN event_type = 'error' THEN 'HTTP ' || (500 + event_id % 4) END AS error FROM events)"""


def batches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 4).alias("instance"), F.col("ts").cast("timestamp").alias("ts"), (1 + F.col("event_id") % 64).alias("size"), (F.col("value") / 1000).alias("wait_seconds"), (F.col("value") / 2000).alias("inference_seconds"))


BATCHES = "batches AS (SELECT user_id % 4 AS instance, ts, 1 + event_id % 64 AS size, value / 1000 AS wait_seconds, value / 2000 AS inference_seconds FROM events)"
