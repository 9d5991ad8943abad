"""Registered queries of scoring, evaluation and sampling (C1-C5, E1-E14, F11, P1-P11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from msgloom.operators import evaluate as E
from msgloom.operators import sampling as P
from msgloom.operators import scoring as C
from msgloom.operators.quality import LABELS
from msgloom.plans import views as V
from msgloom.plans.registry import query
from msgloom.plans.text_queries import FEATURES, SCORE

_P1, _P2 = V.predictions_sql("v1"), V.predictions_sql("v2")
_LB = f"WITH {V.LABELLED}, p1 AS {_P1}, p2 AS {_P2}"


def predictions(spark, d, version):
    return C.decide(V.logits(spark, d, version))


def versions(spark, d):
    """Both versions' predictions; every 20th call failed."""
    both = predictions(spark, d, "v1").withColumn("version", F.lit("v1")).unionByName(predictions(spark, d, "v2").withColumn("version", F.lit("v2")))
    return both.withColumn("success", F.col("row_id") % 20 != 3)


_VERSIONS = f"{_LB}, both_ AS (SELECT *, 'v1' AS version FROM p1 UNION ALL SELECT *, 'v2' FROM p2), v AS (SELECT *, row_id % 20 <> 3 AS success FROM both_)"


@query("c01_decide", f"{_LB} SELECT row_id, pred, round(conf, 6) AS conf FROM p2")
def c01(spark, d):
    return predictions(spark, d, "v2").select("row_id", "pred", F.round("conf", 6).alias("conf"))


def length_scorer():
    """A scorer of the pluggable kind: logits from the text's length and digits."""
    return lambda texts: [[min(len(x), 2000) / 1000, sum(c in "0123456789" for c in x) / 10, x.count("!") / 5] for x in texts]


def picky_scorer():
    """The same, but it fails on any batch with a text of which the second character is ``e``."""
    score = length_scorer()

    def run(texts):
        if any(x[1:2] == "e" for x in texts):
            raise ValueError("cannot read this")
        return score(texts)

    return run


@query("c02_score_messages", f"""WITH {V.MESSAGES}, x AS (SELECT row_id, least(length(text), 2000) / 1000 AS a, len(regexp_extract_all(text, '[0-9]')) / 10 AS b, len(regexp_extract_all(text, '!')) / 5 AS c FROM messages)
  SELECT row_id, CASE WHEN a >= b AND a >= c THEN 'ham' WHEN b >= c THEN 'spam' ELSE 'phishing' END AS pred FROM x""")
def c02(spark, d):
    return C.score_messages(V.messages(spark, d), length_scorer).select("row_id", "pred")


RULED = f"""{FEATURES}, s AS (SELECT *, {SCORE} AS risk FROM features), l AS (SELECT row_id, 1.0 - risk AS h, CASE WHEN emoji_count + len(regexp_extract_all(text, '!')) > 2 THEN 0.6 ELSE 0.1 END + risk / 2 AS s, risk + 0.1 * suspicious_keyword_count AS p FROM s),
  ruled AS (SELECT row_id, CASE WHEN h >= s AND h >= p THEN 'ham' WHEN s >= p THEN 'spam' ELSE 'phishing' END AS pred, 1 / (exp(h - greatest(h, s, p)) + exp(s - greatest(h, s, p)) + exp(p - greatest(h, s, p))) AS conf FROM l)"""


@query("c03_rule_scorer", f"WITH {RULED} SELECT row_id, pred, round(conf, 6) AS conf FROM ruled")
def c03(spark, d):
    return C.rule_scorer(V.noisy(spark, d)).select("row_id", "pred", F.round("conf", 6).alias("conf"))


@query("c04_train_classifier")
def c04(spark, d):
    rows = P.stratified_split(V.labelled(spark, d), {"validation": 0.2}, "train")
    model = C.train_classifier(rows.filter("split = 'train'"), rows.filter("split = 'validation'"))
    return C.classify(model, rows).select("row_id", "label", "split", "pred")


_RULES = [("spam", "drop"), ("phishing", "reject")]


def policed(spark, d):
    x = predictions(spark, d, "v2").withColumnRenamed("pred", "label")
    x = x.withColumn("text", F.when(F.col("row_id") % 31 == 0, "").otherwise(F.col("text")))
    x = x.withColumn("unclassifiable", F.when(F.col("row_id") % 17 == 0, "data_coding_0x04")).withColumn("error", F.when(F.col("row_id") % 23 == 0, "timeout"))
    return C.apply_policy(x, spark.createDataFrame(_RULES, "label string, action string"), threshold=0.5)


POLICED = f"""{_LB}, policed AS (SELECT *, CASE WHEN why IS NOT NULL THEN NULL WHEN conf < 0.5 THEN 'ham' ELSE pred END AS effective_label, coalesce(why, CASE WHEN conf < 0.5 THEN 'below_threshold' WHEN pred = 'ham' THEN 'no_rule' ELSE 'rule' END) AS reason,
  CASE WHEN why IS NULL AND conf >= 0.5 AND pred = 'spam' THEN 'drop' WHEN why IS NULL AND conf >= 0.5 AND pred = 'phishing' THEN 'reject' ELSE 'forward' END AS action
  FROM (SELECT *, CASE WHEN row_id % 31 = 0 OR length(text) = 0 THEN 'empty' WHEN row_id % 17 = 0 THEN 'skipped' WHEN row_id % 23 = 0 THEN 'error' END AS why FROM p2))"""


@query("c05_apply_policy", f"{POLICED} SELECT row_id, effective_label, action, reason FROM policed")
def c05(spark, d):
    return policed(spark, d).select("row_id", "effective_label", "action", "reason")


@query("e01_confusion", f"{_LB} SELECT gold, pred, count(*) AS n FROM p2 GROUP BY ALL")
def e01(spark, d):
    return E.confusion(predictions(spark, d, "v2"))


def _counts(p: str) -> str:
    return f"counts AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn, count(*) FILTER (gold <> label AND pred <> label) AS tn FROM {p}, (VALUES ('ham'), ('spam'), ('phishing')) s(label) GROUP BY label)"


_PRF = "prf AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM counts), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, tp + fn AS support FROM prf)"


@query("e02_per_class", f"{_LB}, {_counts('p2')}, {_PRF} SELECT label, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(f, 4) AS f1, support FROM f")
def e02(spark, d):
    return E.per_class(predictions(spark, d, "v2"))


_ACC = "round_even(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 4)"
_BLOCK = "round_even(avg(CASE WHEN (gold = 'ham') = (pred = 'ham') THEN 1.0 ELSE 0.0 END), 4)"


@query("e03_accuracies", f"{_LB} SELECT count(*) AS n, {_ACC} AS accuracy_3class, {_BLOCK} AS accuracy_block FROM p2")
def e03(spark, d):
    return E.accuracies(predictions(spark, d, "v2"))


@query("e04_accuracy_by", f"{_LB} SELECT 'overall' AS kind, '' AS key, count(*) AS n, {_ACC} AS accuracy FROM p2 UNION ALL SELECT 'category', category, count(*), {_ACC} FROM p2 GROUP BY category UNION ALL SELECT 'language', language, count(*), {_ACC} FROM p2 GROUP BY language")
def e04(spark, d):
    return E.accuracy_by(predictions(spark, d, "v2"))


@query("e05_macro_f1", f"{_LB}, {_counts('p2')}, {_PRF} SELECT round_even(avg(f), 4) AS macro_f1, round_even(sum(p * support) / sum(support), 4) AS weighted_precision, round_even(sum(r * support) / sum(support), 4) AS weighted_recall, round_even(sum(f * support) / sum(support), 4) AS weighted_f1 FROM f")
def e05(spark, d):
    return E.macro_f1(predictions(spark, d, "v2"))


@query("e06_one_vs_rest", f"{_LB}, failed AS (SELECT gold, CASE WHEN row_id % 10 = 0 THEN 'error' ELSE pred END AS pred FROM p2), {_counts('failed')} SELECT label, tp, fp, fn, tn, round_even(100 * tp / (tp + fn), 4) AS accuracy FROM counts")
def e06(spark, d):
    return E.one_vs_rest(predictions(spark, d, "v2").withColumn("pred", F.when(F.col("row_id") % 10 == 0, "error").otherwise(F.col("pred"))))


_GRID = f"""WITH {V.LABELLED}, l AS ({V.logits_sql('v2')}), grid AS (SELECT i * 9 + j AS pos, -2.0 + 0.5 * i AS spam, -2.0 + 0.5 * j AS phishing FROM range(9) a(i), range(9) b(j)),
  x AS (SELECT pos, spam, phishing, gold, CASE WHEN logits[1] >= logits[2] + spam AND logits[1] >= logits[3] + phishing THEN 'ham' WHEN logits[2] + spam >= logits[3] + phishing THEN 'spam' ELSE 'phishing' END AS pred FROM l, grid),
  c AS (SELECT pos, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM x, (VALUES ('ham'), ('spam'), ('phishing')) s(label) GROUP BY ALL),
  pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c),
  m AS (SELECT pos, round_even(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 4) AS macro_f1, round_even(max(r) FILTER (label = 'phishing'), 4) AS phishing_recall FROM pr GROUP BY pos),
  g AS (SELECT pos, spam::DOUBLE AS spam, phishing::DOUBLE AS phishing, {_BLOCK} AS accuracy_block, {_ACC} AS accuracy_3class FROM x GROUP BY ALL), full_ AS (SELECT * FROM g JOIN m USING (pos))"""


@query("e07_calibrate", f"{_GRID} SELECT * EXCLUDE (pos), 'best' AS kind FROM (FROM full_ ORDER BY accuracy_block DESC, macro_f1 DESC, pos LIMIT 1) UNION ALL SELECT * EXCLUDE (pos), 'baseline' FROM full_ WHERE spam = 0 AND phishing = 0")
def e07(spark, d):
    return E.calibrate(V.logits(spark, d, "v2"), "block_then_f1")


_SUMMARY = lambda p, name: f"(SELECT category AS dataset, count(*) AS {name}_n, {_ACC} AS {name}_acc, {_BLOCK} AS {name}_block, round_even(count(*) FILTER (gold = 'phishing' AND pred = 'phishing') / nullif(count(*) FILTER (gold = 'phishing'), 0), 4) AS {name}_phishing_recall FROM {p} GROUP BY category)"


@query("e08_compare_runs", f"{_LB} SELECT * REPLACE (coalesce(before_n, 0) AS before_n, coalesce(after_n, 0) AS after_n) FROM {_SUMMARY('(SELECT * FROM p1 WHERE category <> ' + chr(39) + 'src1' + chr(39) + ')', 'before')} FULL JOIN {_SUMMARY('p2', 'after')} USING (dataset)")
def e08(spark, d):
    own = lambda v: predictions(spark, d, v).withColumnRenamed("category", "dataset")
    return E.compare_runs(E.summary(own("v1").filter("dataset <> 'src1'")), E.summary(own("v2")))


@query("e09_compare_models", f"{_LB}, a AS (SELECT {_ACC} AS old_acc FROM p1), b AS (SELECT {_ACC} AS new_acc FROM p2), fa AS (WITH {_counts('p1')}, {_PRF} SELECT round_even(avg(f), 4) AS old_f1 FROM f), fb AS (WITH {_counts('p2')}, {_PRF} SELECT round_even(avg(f), 4) AS new_f1 FROM f) SELECT *, CASE WHEN new_acc > old_acc OR new_acc = old_acc AND new_f1 > old_f1 THEN 'new' ELSE 'old' END AS better FROM a, b, fa, fb")
def e09(spark, d):
    return E.compare_models(predictions(spark, d, "v1"), predictions(spark, d, "v2"))


@query("e10_paired_comparison", f"""{_LB}, x AS (SELECT p1.row_id, p1.conf AS ca, p2.conf AS cb, CASE WHEN p1.pred = p1.gold AND p2.pred = p1.gold THEN 'both_right' WHEN p1.pred = p1.gold THEN 'only_a' WHEN p2.pred = p1.gold THEN 'only_b' ELSE 'both_wrong' END AS outcome FROM p1 JOIN p2 USING (row_id))
  SELECT outcome, count(*) AS n, round_even(avg(ca), 4) AS conf_a, round_even(avg(cb), 4) AS conf_b, array_to_string(list_sort(list(row_id))[1:3], ',') AS examples FROM x GROUP BY outcome""")
def e10(spark, d):
    return E.paired_comparison(predictions(spark, d, "v1"), predictions(spark, d, "v2"))


@query("e10_paired_summary", f"""{_LB}, x AS (SELECT p1.pred = p1.gold AS a, p2.pred = p1.gold AS b, p1.conf / 10 AS ta, p2.conf / 20 AS tb FROM p1 JOIN p2 USING (row_id)), n AS (SELECT count(*) AS n, count(*) FILTER (a) AS correct_a, count(*) FILTER (b) AS correct_b, round_even(avg(ta), 4) AS time_a, round_even(avg(tb), 4) AS time_b FROM x)
  SELECT *, round_even(correct_a / n, 4) AS accuracy_a, round_even(correct_b / n, 4) AS accuracy_b, round_even((correct_b - correct_a) / n, 4) AS improvement, n - correct_a AS errors_a, n - correct_b AS errors_b FROM n""")
def e10_summary(spark, d):
    return E.paired_summary(predictions(spark, d, "v1").withColumn("time", F.col("conf") / 10), predictions(spark, d, "v2").withColumn("time", F.col("conf") / 20))


@query("e11_category_breakdown", f"{_VERSIONS} SELECT category, version, {_ACC} AS accuracy, count(*) AS samples, count(*) FILTER (gold = pred) AS correct FROM v WHERE success GROUP BY ALL")
def e11(spark, d):
    return E.category_breakdown(versions(spark, d))


@query("e12_vulnerabilities", f"{_VERSIONS}, a AS (SELECT category, version, {_ACC} AS acc FROM v WHERE success GROUP BY ALL) SELECT o.category, o.acc AS old, n.acc AS new, round_even(n.acc - o.acc, 4) AS delta, n.acc < 0.8 AS vulnerable FROM a o JOIN a n ON o.category = n.category AND o.version = 'v1' AND n.version = 'v2'")
def e12(spark, d):
    return E.vulnerabilities(versions(spark, d))


@query("e13_robustness", f"""{_VERSIONS}, a AS (SELECT version, round_even(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 4) AS success_rate, avg(conf) FILTER (success AND gold = pred) AS r, avg(conf) FILTER (success AND gold <> pred) AS w FROM v GROUP BY version)
  SELECT version, success_rate, round_even(r, 4) AS conf_right, round_even(w, 4) AS conf_wrong, round_even(r - w, 4) AS calibration_gap, r - w < 0.3 AS flagged FROM a""")
def e13(spark, d):
    return E.robustness(versions(spark, d))


@query("e14_error_patterns", f"{_LB} SELECT gold, pred, count(*) AS n, round_even(avg(length(text)), 4) AS avg_length, count(*) FILTER (conf < 0.45) AS unsure FROM p2 WHERE gold <> pred GROUP BY gold, pred ORDER BY n DESC, gold, pred LIMIT 5")
def e14(spark, d):
    return E.error_patterns(predictions(spark, d, "v2"), low=0.45)


@query("e14_error_texts", f"{_LB} SELECT gold || '_to_' || pred AS pair, row_id, text, length(text)::INTEGER AS length, round(conf, 6) AS conf FROM p2 WHERE gold <> pred")
def e14_texts(spark, d):
    return E.error_texts(predictions(spark, d, "v2")).withColumn("conf", F.round("conf", 6))


@query("f11_low_confidence", f"{_LB}, c AS (SELECT row_id, CASE WHEN gold = pred THEN conf ELSE 1 - conf END AS confidence FROM p2) SELECT row_id, round(confidence, 6) AS confidence FROM c WHERE confidence < 0.45")
def f11(spark, d):
    return E.low_confidence(predictions(spark, d, "v2"), 0.45).select("row_id", F.round("confidence", 6).alias("confidence"))


_ORDER = lambda key="row_id", seed="42": f"md5('{seed}|' || {key}), {key}"
_RANKED = lambda by, view="labelled": f"WITH {V.STRATA}, r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {_ORDER()}) AS r, count(*) OVER (PARTITION BY {by}) AS size, count(*) OVER () AS total FROM {view})"


@query("p01_undersample", f"{_RANKED('label')} SELECT row_id, label FROM r WHERE r <= (SELECT min(size) FROM r)")
def p01(spark, d):
    return P.undersample(V.labelled(spark, d)).select("row_id", "label")


@query("p02_cap_class", f"{_RANKED('label', 'strata')} SELECT row_id, label FROM r WHERE label IS DISTINCT FROM 'ham' OR r <= 100")
def p02(spark, d):
    return P.cap_class(V.strata(spark, d), n=100).select("row_id", "label")


@query("p03_sample_per_label", f"{_RANKED('label')} SELECT row_id, label FROM r WHERE r <= 40")
def p03(spark, d):
    return P.sample_per_label(V.labelled(spark, d), 40).select("row_id", "label")


@query("p04_stratified_sample", f"{_RANKED('language', 'strata')} SELECT row_id, language FROM r WHERE r <= greatest(1, round_even(size * 100 / total, 0))")
def p04(spark, d):
    return P.stratified_sample(V.strata(spark, d), 100).select("row_id", "language")


@query("p05_stratified_split", f"{_RANKED('label', 'strata')} SELECT row_id, CASE WHEN r <= greatest(1, floor(size * 0.15 + 1e-9)) THEN 'validation' ELSE 'train' END AS split FROM r")
def p05(spark, d):
    return P.stratified_split(V.strata(spark, d), {"validation": 0.15}, "train", least=1).select("row_id", "split")


@query("p06_three_way_split", f"{_RANKED('label', 'strata')} SELECT row_id, CASE WHEN r <= floor(size * 0.7 + 1e-9) THEN 'train' WHEN r <= floor(size * 0.7 + 1e-9) + floor(size * 0.1 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM r")
def p06(spark, d):
    return P.stratified_split(V.strata(spark, d), {"train": 0.7, "validation": 0.1}, "test").select("row_id", "split")


_HASH = lambda s: f"('0x' || substr(md5({s}), 1, 8))::BIGINT"


@query("p07_random_split", f"WITH {V.MESSAGES} SELECT row_id, {_HASH(chr(39) + '42|' + chr(39) + ' || row_id')} < {int(0.1 * (1 << 32))} AS held FROM messages")
def p07(spark, d):
    return P.random_split(V.messages(spark, d)).select("row_id", "held")


_DRAWN = _HASH("'42|' || row_id || CASE WHEN piece > 0 THEN '|' || piece ELSE '' END") + " / 4294967296.0"


@query("p08_balanced_resample", f"""WITH RECURSIVE {V.STRATA}, s AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS mean FROM strata GROUP BY label),
  more AS (SELECT label, mean, greatest(ceil(mean / {P.PIECE}) - 1, 0)::INTEGER AS more FROM s), pieces AS (SELECT label, more, unnest(range(0, more + 1))::INTEGER AS piece, mean FROM more),
  parts AS (SELECT label, piece, CASE WHEN piece = 0 THEN mean - {P.PIECE} * more ELSE {P.PIECE} END::DOUBLE AS m FROM pieces),
  rungs AS (SELECT label, piece, m, 0 AS k, exp(-m) AS p, exp(-m) AS upto FROM parts UNION ALL SELECT label, piece, m, k + 1, p * m / (k + 1), upto + p * m / (k + 1) FROM rungs WHERE k < ceil(m + 8 * sqrt(m) + 16)),
  ladders AS (SELECT label, piece, list(upto ORDER BY k) AS ladder FROM rungs GROUP BY label, piece),
  drawn AS (SELECT row_id, x.label, len(list_filter(ladder, lambda y: y <= u)) AS n FROM (SELECT row_id, l.label, ladder, {_DRAWN} AS u FROM strata l JOIN ladders q ON l.label IS NOT DISTINCT FROM q.label) x),
  n AS (SELECT row_id, label, sum(n)::INTEGER AS n FROM drawn GROUP BY ALL)
  SELECT row_id, label, unnest(range(1, n + 1))::INTEGER AS copy FROM n""")
def p08(spark, d):
    return P.balanced_resample(V.strata(spark, d)).select("row_id", "label", "copy")


@query("p09_rehearsal_mix", f"{_RANKED('label')} SELECT row_id, label FROM r WHERE language <> 'en' UNION ALL SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_ORDER()}) AS q FROM r WHERE language = 'en') WHERE q <= 20")
def p09(spark, d):
    x = V.labelled(spark, d)
    return P.rehearsal_mix(x.filter("language <> 'en'"), x.filter("language = 'en'"), 20).select("row_id", "label")


@query("p10_take_sample", f"WITH {V.MESSAGES} SELECT row_id FROM messages ORDER BY {_ORDER()} LIMIT 50")
def p10(spark, d):
    return P.take_sample(V.messages(spark, d), 50).select("row_id")


@query("p11_shuffle", f"WITH {V.MESSAGES} SELECT row_id, text FROM messages ORDER BY {_ORDER()}")
def p11(spark, d):
    return P.shuffle(V.messages(spark, d)).select("row_id", "text")
