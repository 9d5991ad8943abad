"""Registered queries of the audit log, events and traffic (F9, F10, A12-A20, N1-N4, W1-W3, W5, W7, W9 in batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgloom.operators import audit as A
from msgloom.operators import traffic as R
from msgloom.plans import eval_queries as Q
from msgloom.plans import views as V
from msgloom.plans.registry import query
from msgloom.plans.text_queries import PRIORITY, TITLE
from msgloom.sources import audit_store

_A = f"WITH {V.AUDIT}"
_TYPE = "CASE entry_type WHEN 'prediction' THEN 'PredictionEvent' WHEN 'feedback' THEN 'FeedbackEvent' WHEN 'access_denied' THEN 'SecurityEvent' ELSE 'SystemEvent' END"


@query("f09_query_audit", f"{_A} SELECT event_id AS number, entry_type, client_ip FROM audit WHERE entry_type = 'prediction' AND timestamp BETWEEN '2024-01-05' AND '2024-01-20' ORDER BY timestamp DESC LIMIT 100")
def f09(spark, d):
    return audit_store.query(spark, V.stored(spark, d), "prediction", "2024-01-05", "2024-01-20", limit=100).select("number", "entry_type", "client_ip")


def _events(spark, d):
    return A.to_events(V.logged(spark, d))


@query("f10_query_events", f"""{_A}, e AS (SELECT *, {PRIORITY} AS priority, {_TYPE} AS type FROM audit), hit AS (SELECT *, count(*) OVER () AS total FROM e WHERE type = 'SecurityEvent' AND priority = 'high' AND timestamp >= '2024-01-10')
  SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS at, {TITLE} AS title, priority, total, total > 60 AS has_more FROM hit ORDER BY timestamp DESC LIMIT 20 OFFSET 40""")
def f10(spark, d):
    page = A.query_events(_events(spark, d), event_type="SecurityEvent", priority="high", start="2024-01-10", limit=20, offset=40)
    return page.select(F.date_format("eventTime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "title", "priority", "total", "has_more")


@query("f10_next_page", f"""{_A}, e AS (SELECT *, {PRIORITY} AS priority, {_TYPE} AS type FROM audit WHERE timestamp >= '2024-01-10'), hit AS (SELECT *, count(*) OVER () AS total FROM e WHERE type = 'SecurityEvent')
  SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS at, {TITLE} AS title, priority, total > 40 AS has_more FROM hit ORDER BY timestamp DESC LIMIT 20 OFFSET 20""")
def f10_next(spark, d):
    """The second page of the days from a bound on, by the key of the first page's last row."""
    events = A.to_events(audit_store.read(spark, V.stored(spark, d), "2024-01-10")).filter("eventType = 'SecurityEvent'")
    last = audit_store.event_page(events).orderBy("eventTime", F.desc("id")).select("eventTime", "id").first()
    page = audit_store.event_page(events, after=tuple(last) if last else None)
    return page.select(F.date_format("eventTime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "title", "priority", "has_more")


@query("a12_audit_statistics", f"""{_A} SELECT count(*) AS total, count(*) FILTER (entry_type = 'prediction') AS predictions, count(*) FILTER (entry_type = 'feedback') AS feedback, count(*) FILTER (entry_type = 'access_denied') AS denied,
  count(*) FILTER (label = 'ham') AS label_ham, count(*) FILTER (label = 'spam') AS label_spam, count(*) FILTER (label = 'phishing') AS label_phishing, round_even(avg(confidence) FILTER (entry_type = 'prediction'), 4) AS avg_confidence, count(DISTINCT client_ip) FILTER (client_ip <> 'system') AS clients FROM audit""")
def a12(spark, d):
    return A.audit_statistics(V.audit(spark, d))


@query("a12_model_counts", f"{_A} SELECT model, count(*) AS n FROM audit WHERE entry_type = 'prediction' GROUP BY model")
def a12_models(spark, d):
    return A.model_counts(V.audit(spark, d))


_STATISTICS = """SELECT kind, key, count(*) AS n, count(DISTINCT client_ip) AS sources, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last, round_even(avg(confidence), 4) AS confidence FROM g GROUP BY kind, key"""
_KINDS = "SELECT 'type' AS kind, type AS key, * FROM e UNION ALL SELECT 'priority', priority, * FROM e UNION ALL SELECT 'model', system, * FROM e UNION ALL SELECT 'all', '', * FROM e"


def _statistics(x):
    return x.select("kind", "key", "n", "sources", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first", "last")), "confidence")


@query("a12_clients_between", f"{_A} SELECT entry_type, count(*) AS n, true AS near FROM audit WHERE timestamp >= '2024-01-05' AND timestamp < '2024-01-21' GROUP BY entry_type")
def a12_between(spark, d):
    """Clients of a range of days from the days' sketches, each within 3 % of the exact count."""
    path = V.new_folder(spark)
    A.client_sketches(V.audit(spark, d).withColumn("event_id", F.col("event_id").cast("string"))).write.parquet(path)
    got = A.clients_between(spark.read.parquet(path), "2024-01-05", "2024-01-20", ["entry_type"])
    own = V.audit(spark, d).filter("timestamp >= '2024-01-05' and timestamp < '2024-01-21'")
    exact = own.groupBy("entry_type").agg(F.count_distinct(F.when(F.col("client_ip") != "system", F.col("client_ip"))).alias("exact"))
    return got.join(exact, "entry_type").select("entry_type", "n", (F.abs(F.col("clients") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"))


@query("a13_event_statistics", f"{_A}, e AS (SELECT *, {PRIORITY} AS priority, {_TYPE} AS type, coalesce(model, 'msgloom') AS system FROM audit), g AS ({_KINDS}) {_STATISTICS}")
def a13(spark, d):
    return _statistics(A.event_statistics(_events(spark, d)))


@query("a13_former_statistics", f"""{_A}, e AS (SELECT *, CASE {_TYPE} WHEN 'PredictionEvent' THEN 'low' WHEN 'FeedbackEvent' THEN 'medium' ELSE 'high' END AS priority, {_TYPE} AS type, CASE WHEN entry_type = 'prediction' THEN coalesce(model, 'msgloom') END AS system FROM audit WHERE entry_type <> 'system_event'),
  g AS (SELECT * FROM ({_KINDS}) WHERE key IS NOT NULL) {_STATISTICS}""")
def a13_former(spark, d):
    return _statistics(A.event_statistics(_events(spark, d), reference_compat=True))


def _jobs(spark, d):
    """Orders as inference jobs."""
    o = V.table(spark, d, "orders")
    return o.select(F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("creationDate"))


@query("a14_job_statistics", "SELECT o_orderstatus AS state, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM orders GROUP BY o_orderstatus")
def a14(spark, d):
    return A.job_statistics(_jobs(spark, d))


@query("a15_list_jobs", "SELECT 'job-' || o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, 'job-' || o_orderkey LIMIT 50 OFFSET 10")
def a15(spark, d):
    return A.list_jobs(_jobs(spark, d), state="F", limit=50, offset=10).select("id", "priority")


@query("a16_policy_counters", f"{Q.POLICED} SELECT count(*) AS received, count(effective_label) AS classified, count(*) FILTER (action = 'forward') AS forwarded, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action = 'drop') AS dropped, count(*) FILTER (reason = 'skipped') AS skipped_encoding, count(*) FILTER (reason = 'error') AS errors FROM policed")
def a16(spark, d):
    return R.policy_counters(Q.policed(spark, d))


def _percentiles(q: int, least: int) -> str:
    low = f"((n + 1) * {q} // 100)"
    at = lambda i: f"max(v) FILTER (i = {i})"
    return f"CASE WHEN max(n) < {least} THEN 0.0 ELSE {at(low + ' - 1')} + max((n + 1) * {q} / 100 - {low}) * ({at(low)} - {at(low + ' - 1')}) END AS p{q}_exclusive, {at(f'n * {q} // 100')} AS p{q}_index"


@query("a17_latency_stats", f"""WITH {V.REQUESTS}, per AS (SELECT scenario, count(*) AS n, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, (max(epoch_us(started)) - min(epoch_us(started))) / 1e6 AS took FROM requests GROUP BY scenario),
  r AS (SELECT scenario, response_time AS v, row_number() OVER (PARTITION BY scenario ORDER BY response_time, request_index) - 1 AS i, count(*) OVER (PARTITION BY scenario) AS n FROM requests WHERE success),
  s AS (SELECT scenario, avg(v) AS mean, min(v) AS shortest, max(v) AS longest, stddev_samp(v) AS deviation, max(v) FILTER (i = n // 2) AS median, {_percentiles(95, 21)}, {_percentiles(99, 101)} FROM r GROUP BY scenario)
  SELECT scenario, n, ok, failed, round_even(100 * ok / n, 4) AS success_percent, round_even(CASE WHEN took > 0 THEN n / took ELSE 0.0 END, 6)::DOUBLE AS throughput, {', '.join(f'round_even({c}, 4)::DOUBLE AS {c}' for c in ('mean', 'shortest', 'longest', 'median', 'deviation', 'p95_exclusive', 'p95_index', 'p99_exclusive', 'p99_index'))} FROM per JOIN s USING (scenario)""")
def a17(spark, d):
    return R.latency_stats(V.requests(spark, d), ["scenario"], "started")


@query("a18_error_counts", f"WITH {V.REQUESTS} SELECT error, count(*) AS n FROM requests WHERE NOT success GROUP BY error")
def a18(spark, d):
    return R.error_counts(V.requests(spark, d))


@query("a18_label_counts", f"WITH {V.REQUESTS} SELECT label, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM requests WHERE success GROUP BY label")
def a18_labels(spark, d):
    return R.success_labels(V.requests(spark, d))


@query("a19_server_load", f"WITH {V.REQUESTS} SELECT request_index % 7 AS server, count(*) AS n, round_even(avg(response_time), 4) AS mean FROM requests GROUP BY 1")
def a19(spark, d):
    return R.server_load(V.requests(spark, d), 7)


@query("a20_batch_histogram", f"WITH {V.BATCHES} SELECT CASE WHEN size <= 1 THEN 1 ELSE pow(2, ceil(log2(size)))::BIGINT END AS bucket, count(*) AS batches, sum(size)::BIGINT AS requests, round_even(sum(inference_seconds), 4) AS inference_seconds, round_even(sum(wait_seconds), 4) AS wait_seconds FROM batches GROUP BY 1")
def a20(spark, d):
    return R.batch_histogram(V.batches(spark, d))


@query("n01_to_events", f"""{_A} SELECT event_id, {_TYPE} AS "eventType", {PRIORITY} AS priority, {TITLE} AS title, client_ip AS source_id, CASE WHEN client_ip = 'system' THEN 'system' ELSE 'client' END AS role, coalesce(model, 'msgloom') AS system_id,
  CASE entry_type WHEN 'prediction' THEN 6 WHEN 'feedback' THEN 6 WHEN 'access_denied' THEN 2 ELSE 3 END AS characteristics FROM audit""")
def n01(spark, d):
    a = V.logged(spark, d)
    keys = a.select(F.col("number").alias("event_id"), A.event_key(a).alias("id"))
    return A.to_events(a).join(keys, "id").select("event_id", "eventType", "priority", "title", F.col("source.id").alias("source_id"), F.col("source.role").alias("role"), F.col("reportingSystem.id").alias("system_id"), F.size("characteristic").alias("characteristics"))


@query("n02_event_by_id", f"{_A} SELECT {_TYPE} AS \"eventType\", {PRIORITY} AS priority, {TITLE} AS title, client_ip AS source_id FROM audit WHERE event_id = 7")
def n02(spark, d):
    """The event of one entry, found by its id among all events."""
    a = V.logged(spark, d)
    own = a.filter("number = 7").select(A.event_key(a)).first()[0]
    return A.event_by_id(A.to_events(a), own).select("eventType", "priority", "title", F.col("source.id").alias("source_id"))


@query("n03_characteristics_long", f"""{_A}, c AS (SELECT {_TYPE} AS type, unnest(CASE entry_type WHEN 'prediction' THEN [['label', label], ['confidence', ''], ['processing_time_ms', ''], ['text_length', ''], ['text_hash', ''], ['redaction_applied', '']]
  WHEN 'feedback' THEN [['feedback_id', ''], ['original_label', ''], ['user_feedback', ''], ['thumbs_up', thumbs_up::VARCHAR], ['thumbs_down', thumbs_down::VARCHAR], ['text_hash', '']]
  WHEN 'access_denied' THEN [['endpoint', endpoint], ['reason', reason]] ELSE [['event_type', event_type], ['message', message], ['metadata_user', meta_user]] END) AS p FROM audit)
  SELECT type AS "eventType", p[1] AS name, CASE WHEN p[1] IN ('confidence', 'feedback_id', 'text_hash') THEN '' ELSE p[2] END AS value, count(*) AS n FROM c GROUP BY ALL""")
def n03(spark, d):
    x = A.characteristics_long(_events(spark, d))
    value = F.when(F.col("name").isin("confidence", "feedback_id", "text_hash"), "").otherwise(F.col("value"))
    return x.groupBy("eventType", "name", value.alias("value")).agg(F.count("*").alias("n"))


@query("n04_manual_events", f"{_A} SELECT event_id, 'manual_event' AS entry_type, client_ip, 'Note ' || event_id AS title, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'low' END AS priority FROM audit WHERE entry_type = 'system_event'")
def n04(spark, d):
    x = V.logged(spark, d).filter("entry_type = 'system_event'").withColumn("title", F.concat(F.lit("Note "), F.col("number").cast("string"))).withColumn("description", F.lit("")).withColumn("priority", F.when(F.col("number") % 2 == 0, "high"))
    return A.manual_events(x).select(F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("event_id"), "entry_type", "client_ip", "title", "priority")


@query("w01_rolling_rate", f"""WITH {V.BATCHES}, x AS (SELECT instance, ts, size, sum(size) OVER (PARTITION BY instance ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS total, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY instance)) / 1e6 AS up FROM batches)
  SELECT instance, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, size, round_even(CASE WHEN up > 0 THEN total / least(3600.0, up) ELSE 0.0 END, 4)::DOUBLE AS rate FROM x""")
def w01(spark, d):
    return R.rolling_rate(V.batches(spark, d), 3600).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("w02_lifetime_rate", f"WITH {V.BATCHES} SELECT instance, sum(size)::BIGINT AS total, round_even(sum(size) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 6) AS rate FROM batches GROUP BY instance")
def w02(spark, d):
    return R.lifetime_rate(V.batches(spark, d))


def actions(spark, d):
    """Audited predictions as policy actions over time."""
    action = F.when(F.col("label") == "spam", "drop").when(F.col("label") == "phishing", "reject").otherwise("forward")
    return V.audit(spark, d).filter("entry_type = 'prediction'").select(F.col("timestamp").alias("ts"), action.alias("action"), "client_ip", "label", "model", "confidence")


@query("w03_stats_per_minute", f"{_A} SELECT strftime(date_trunc('minute', timestamp), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS received, count(*) FILTER (label = 'ham') AS forwarded, count(*) FILTER (label = 'phishing') AS rejected, count(*) FILTER (label = 'spam') AS dropped FROM audit WHERE entry_type = 'prediction' GROUP BY 1")
def w03(spark, d):
    return R.stats_per_minute(actions(spark, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("w04_classify_stream", f"""WITH {Q.RULED}, why AS (SELECT r.*, CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN r.row_id % 17 = 0 THEN 'skipped' END AS why FROM ruled r JOIN noisy USING (row_id))
  SELECT row_id, CASE WHEN why IS NULL AND conf >= 0.45 AND pred = 'spam' THEN 'drop' WHEN why IS NULL AND conf >= 0.45 AND pred = 'phishing' THEN 'reject' ELSE 'forward' END AS action,
    coalesce(why, CASE WHEN conf < 0.45 THEN 'below_threshold' WHEN pred = 'ham' THEN 'no_rule' ELSE 'rule' END) AS reason FROM why""")
def w04(spark, d):
    """Messages that arrive as files are scored, policed and written by action as a stream; what the sink holds at its end."""
    from msgloom.streaming import streams

    path = V.new_folder(spark)
    x = V.noisy(spark, d).select("row_id", "text", F.when(F.col("row_id") % 17 == 0, "data_coding_0x04").alias("unclassifiable"), F.lit(None).cast("string").alias("error"))
    x.write.parquet(f"{path}/in")
    rules = spark.createDataFrame(Q._RULES, "label string, action string")
    stream = streams.classify_stream(spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in"), rules, 0.45)
    streams.write_by_action(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("row_id", "action", "reason")


@query("w04_scored_stream", f"""WITH {V.MESSAGES}, x AS (SELECT row_id, text, least(length(text), 2000) / 1000 AS a, len(regexp_extract_all(text, '[0-9]')) / 10 AS b, len(regexp_extract_all(text, '!')) / 5 AS c FROM messages),
  s AS (SELECT row_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN substr(text, 2, 1) = 'e' THEN 'error' END AS why, CASE WHEN a >= b AND a >= c THEN 'ham' WHEN b >= c THEN 'spam' ELSE 'phishing' END AS pred,
    1 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))) AS conf FROM x)
  SELECT row_id, CASE WHEN why IS NULL AND conf >= 0.45 AND pred = 'spam' THEN 'drop' WHEN why IS NULL AND conf >= 0.45 AND pred = 'phishing' THEN 'reject' ELSE 'forward' END AS action,
    coalesce(why, CASE WHEN conf < 0.45 THEN 'below_threshold' WHEN pred = 'ham' THEN 'no_rule' ELSE 'rule' END) AS reason FROM s""")
def w04_scored(spark, d):
    """A model in the stream that fails on some messages; what the sink holds at its end."""
    from msgloom.streaming import streams

    path = V.new_folder(spark)
    x = V.messages(spark, d).select("row_id", "text", *(F.lit(None).cast("string").alias(c) for c in ("unclassifiable", "error")))
    x.write.parquet(f"{path}/in")
    rules = spark.createDataFrame(Q._RULES, "label string, action string")
    stream = streams.classify_stream(spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in"), rules, 0.45, Q.picky_scorer)
    streams.write_by_action(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("row_id", "action", "reason")


def submits(spark, d):
    """Messages sent; two thirds are stored under their number in hex, half of those with a leading 0."""
    e = V.table(spark, d, "events").filter("event_type in ('view', 'click')").withColumn("ts", F.col("ts").cast("timestamp"))
    number = F.col("event_id") + 100000
    stored = F.when(F.col("event_id") % 3 == 0, F.lower(F.hex(number))).when(F.col("event_id") % 3 == 1, number.cast("string")).otherwise(F.concat(F.lit("0"), F.lower(F.hex(number))))
    return e.select(stored.alias("message_id"), "ts")


def receipts(spark, d):
    """A receipt of each, 1 to 36 hours later."""
    e = V.table(spark, d, "events").filter("event_type in ('view', 'click')").withColumn("ts", F.col("ts").cast("timestamp"))
    number = F.col("event_id") + 100000
    return e.select(F.col("event_id").alias("receipt_id"), (F.col("ts") + F.make_dt_interval(F.lit(0), (1 + F.col("event_id") % 36).cast("int"))).alias("ts"), F.lit(4).alias("esm_class"), F.concat(F.lit("id:"), number.cast("string"), F.lit(" sub:001 dlvrd:001 stat:DELIVRD")).alias("report"))


@query("w05_correlate_receipts", """SELECT event_id AS receipt_id, CASE event_id % 3 WHEN 0 THEN lower(to_hex(event_id + 100000)) WHEN 1 THEN (event_id + 100000)::VARCHAR ELSE '0' || lower(to_hex(event_id + 100000)) END AS message_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS form
  FROM events WHERE event_type IN ('view', 'click') AND 1 + event_id % 36 <= 24""")
def w05(spark, d):
    return R.match_receipts(submits(spark, d), receipts(spark, d)).select("receipt_id", "message_id", "form")


@query("w06_late_receipts", "SELECT event_id AS receipt_id FROM events WHERE event_type IN ('view', 'click') AND 1 + event_id % 36 > 24")
def w06(spark, d):
    """Receipts that come after the message is forgotten."""
    r = receipts(spark, d)
    return R.unmatched_receipts(r, R.match_receipts(submits(spark, d), r)).select("receipt_id")


def _end(df, columns):
    """One row two days after all others, so that the watermark passes them."""
    last = df.agg((F.max("ts") + F.make_dt_interval(F.lit(2))).alias("ts"))
    return df.unionByName(last.select("ts", *(F.lit(v).alias(c) for c, v in columns.items())), allowMissingColumns=True)


def _stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("w06_settled_stream", """WITH r AS (SELECT event_id AS receipt_id, event_id % 3 AS k, event_id + 100000 AS number, 1 + event_id % 36 AS hours FROM events WHERE event_type IN ('view', 'click'))
  SELECT receipt_id, CASE WHEN hours <= 24 THEN CASE k WHEN 0 THEN lower(to_hex(number)) WHEN 1 THEN number::VARCHAR ELSE '0' || lower(to_hex(number)) END END AS message_id, CASE WHEN hours <= 24 THEN CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END END AS form FROM r""")
def w06_stream(spark, d):
    """All receipts of a stream, matched or not; what the sink holds at its end."""
    from msgloom.streaming.receipts import settled_receipts
    from msgloom.streaming.state import write_available

    path = V.new_folder(spark)
    sent = _stream(spark, _end(submits(spark, d), {"message_id": "end"}), f"{path}/sent")
    back = _stream(spark, _end(receipts(spark, d), {"receipt_id": -1, "esm_class": 4, "report": "id:end "}), f"{path}/back")
    return write_available(settled_receipts(sent, back), f"{path}/out", f"{path}/state").select("receipt_id", "message_id", "form")


@query("w07_client_sessions", f"""{_A}, a AS (SELECT *, CASE WHEN timestamp >= lag(timestamp) OVER w + INTERVAL 6 HOURS OR lag(timestamp) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM audit WHERE entry_type = 'prediction' WINDOW w AS (PARTITION BY client_ip ORDER BY timestamp)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY client_ip ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS session FROM a)
  SELECT client_ip, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(timestamp) + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS messages FROM s GROUP BY client_ip, session""")
def w07(spark, d):
    x = R.client_sessions(actions(spark, d), "6 hours")
    return x.select("client_ip", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")), "messages")


@query("w08_audit_stream_stats", f"{_A} SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS day, label, model, count(*) AS n, round_even(avg(confidence), 4) AS avg_confidence, true AS clients FROM audit WHERE entry_type = 'prediction' GROUP BY 1, 2, 3")
def w08(spark, d):
    from msgloom.streaming.streams import audit_stats

    x = actions(spark, d)
    exact = x.groupBy(F.window("ts", "1 day")["start"].alias("start"), "label", "model").agg(F.count_distinct("client_ip").alias("exact"))
    got = audit_stats(x, "1 day").join(exact, ["start", "label", "model"])
    near = F.abs(F.col("clients") - F.col("exact")) <= 0.03 * F.col("exact")  # clients are an estimate
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "label", "model", "n", F.bround("avg_confidence", 4).alias("avg_confidence"), near.alias("clients"))


_BATCHED = """WITH RECURSIVE m AS (SELECT user_id % 4 AS instance, event_id AS message_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 4 ORDER BY epoch_us(ts), event_id) AS k FROM events),
  b AS (SELECT instance, k, us AS first, 1 AS size, 0::BIGINT AS batch FROM m WHERE k = 1 UNION ALL
    SELECT m.instance, m.k, CASE WHEN b.size >= 8 OR m.us - b.first > 3600000000 THEN m.us ELSE b.first END, CASE WHEN b.size >= 8 OR m.us - b.first > 3600000000 THEN 1 ELSE b.size + 1 END, b.batch + CASE WHEN b.size >= 8 OR m.us - b.first > 3600000000 THEN 1 ELSE 0 END
    FROM b JOIN m ON m.instance = b.instance AND m.k = b.k + 1)
  SELECT m.instance, m.message_id, b.batch FROM b JOIN m USING (instance, k)"""


def _arrivals(spark, d):
    e = V.table(spark, d, "events")
    return e.select((F.col("user_id") % 4).alias("instance"), F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))


@query("w09_micro_batch_assign", _BATCHED)
def w09(spark, d):
    return R.micro_batch_assign(_arrivals(spark, d), 8, 3_600_000.0)


@query("w09_micro_batch_stream", _BATCHED)
def w09_stream(spark, d):
    """The same of a stream; what the sink holds at its end."""
    from msgloom.streaming.batcher import micro_batches
    from msgloom.streaming.state import write_available

    path = V.new_folder(spark)
    x = _stream(spark, _end(_arrivals(spark, d), {"instance": 99, "message_id": -1}), f"{path}/in")
    return write_available(micro_batches(x, 8, 3_600_000.0), f"{path}/out", f"{path}/state")
