"""Registered queries of filters, relabelling, de-duplication, decontamination and corpus statistics (F1-F8, A1-A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgloom.functions import text as T
from msgloom.operators import quality as Q
from msgloom.plans import views as V
from msgloom.plans.registry import query
from msgloom.plans.text_queries import _SPACE, RANGES_SQL, SCRIPT_SQL

_W = r"[\p{L}\p{N}_]"
_SQ = rf"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"
_CLEANED = rf"regexp_replace(regexp_replace({_SQ}, '\\+$', ''), '^\s*\d+\|', '')"
_VALID = rf"""(length({_SQ}) >= 3 AND NOT regexp_matches(text, '^\s*\p{{Nd}}+\s*$') AND NOT regexp_matches(text, '^\s*\({_W}+\)\s*$') AND NOT regexp_matches(text, '^\s*\|.*\|')
  AND NOT regexp_matches(lower(text), 'voicespin.*account balance') AND NOT regexp_matches(text, '^\s*([()]|{_W})+\s*$'))"""
_TOLD = rf"(regexp_matches(lower(text), '{'|'.join(Q.VERIFICATION)}') OR (contains(lower(text), 'transfer') AND contains(lower(text), 'security code')))"
_CLEAN = f"""{V.LABELLED}, cleaned AS (SELECT row_id, {_CLEANED} AS text, language, category, label FROM labelled),
  fixed AS (SELECT row_id, text, CASE WHEN label = 'phishing' AND {_TOLD} THEN 'ham' ELSE label END AS label FROM cleaned WHERE {_VALID}),
  clean AS (SELECT min(row_id) AS row_id, text, arg_min(label, row_id) AS label FROM fixed GROUP BY text)"""


@query("f01_valid_entries", f"WITH {V.NOISY} SELECT row_id FROM noisy WHERE {_VALID}")
def f01(spark, d):
    return Q.valid_entries(V.noisy(spark, d)).select("row_id")


_CODES = " your code is 1234"


def _coded(spark, d):
    """Labelled rows, some with a verification code put in."""
    return V.labelled(spark, d).withColumn("text", F.when(F.col("row_id") % 2 == 0, F.concat("text", F.lit(_CODES))).otherwise(F.col("text")))


@query("f02_fix_labels", f"WITH {V.LABELLED}, coded AS (SELECT row_id, label, CASE WHEN row_id % 2 = 0 THEN text || '{_CODES}' ELSE text END AS text FROM labelled) SELECT row_id, CASE WHEN label = 'phishing' AND {_TOLD} THEN 'ham' ELSE label END AS label FROM coded")
def f02(spark, d):
    return Q.fix_labels(_coded(spark, d)).select("row_id", "label")


@query("f03_dedup_keep_first", f"WITH {V.MESSAGES} SELECT min(row_id) AS row_id, arg_min(language, row_id) AS language, text FROM messages GROUP BY text")
def f03(spark, d):
    return Q.dedup_keep_first(V.messages(spark, d), ["text"]).select("row_id", "language", "text")


@query("f04_dedup_pairs", f"WITH {V.LABELLED} SELECT DISTINCT text, label FROM labelled")
def f04(spark, d):
    return Q.dedup_pairs(V.labelled(spark, d)).select("text", "label")


@query("f05_duplicate_report", f"WITH {V.MESSAGES} SELECT substr(text, 1, 50) AS preview, n FROM (SELECT text, count(*) AS n FROM messages GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, text LIMIT 10)")
def f05(spark, d):
    return Q.duplicate_report(V.messages(spark, d))


@query("f06_clean_dataset", f"WITH {_CLEAN} SELECT row_id, text, label FROM clean")
def f06(spark, d):
    return Q.clean_dataset(V.labelled(spark, d)).select("row_id", "text", "label")


@query("flagship_label_imbalance", f"""WITH {_CLEAN}, n AS (SELECT count(*) FILTER (label = 'ham') AS ham, count(*) FILTER (label = 'spam') AS spam, count(*) FILTER (label = 'phishing') AS phishing FROM clean)
  SELECT ham, spam, phishing, round_even(ham / spam, 4) AS ham_to_spam, round_even(ham / phishing, 4) AS ham_to_phishing, CASE WHEN ham / spam > 5 THEN 'severe' WHEN ham / spam > 3 THEN 'moderate' ELSE 'fine' END AS spam_severity,
  CASE WHEN ham / phishing > 5 THEN 'severe' WHEN ham / phishing > 3 THEN 'moderate' ELSE 'fine' END AS phishing_severity, greatest(ham, spam, phishing) > 3 * least(ham, spam, phishing) AS balance FROM n""")
def flagship(spark, d):
    return Q.imbalance(Q.clean_dataset(V.labelled(spark, d)))


_TRAIN = "train AS (SELECT text FROM messages UNION ALL SELECT text FROM benchmark WHERE item_id % 4 = 0)"


@query("f07_contamination_rate", f"WITH {V.MESSAGES}, {_TRAIN}, own AS (SELECT DISTINCT text FROM benchmark), hit AS (SELECT text, text IN (SELECT text FROM train) AS seen FROM own) SELECT count(*) AS n, count(*) FILTER (seen) AS seen, round_even(count(*) FILTER (seen) / count(*), 4) AS rate FROM hit")
def f07(spark, d):
    b = V.table(spark, d, "benchmark")
    return Q.contamination_rate(b, V.messages(spark, d).select("text").unionByName(b.filter("item_id % 4 = 0").select("text")))


_WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


@query("f08_decontaminate", f"""WITH {V.MESSAGES}, own AS (SELECT item_id, len({_WORDS}) AS m, unnest({_WORDS}) AS word FROM benchmark), there AS (SELECT row_id, unnest({_WORDS}) AS word FROM messages),
  hits AS (SELECT item_id FROM own JOIN there USING (word) GROUP BY item_id, row_id, m HAVING count(*) >= 0.8 * m)
  SELECT item_id, text FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM hits) AND text NOT IN (SELECT text FROM messages WHERE text IS NOT NULL)""")
def f08(spark, d):
    return Q.decontaminate(V.table(spark, d, "benchmark"), V.messages(spark, d))


@query("a01_label_distribution", f"WITH {V.LABELLED} SELECT label, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM labelled GROUP BY label")
def a01(spark, d):
    return Q.label_distribution(V.labelled(spark, d))


@query("a02_imbalance", f"""WITH {V.LABELLED}, n AS (SELECT count(*) FILTER (label = 'ham') AS ham, count(*) FILTER (label = 'spam') AS spam, count(*) FILTER (label = 'phishing') AS phishing FROM labelled)
  SELECT ham, spam, phishing, round_even(ham / spam, 4) AS ham_to_spam, round_even(ham / phishing, 4) AS ham_to_phishing, CASE WHEN ham / spam > 5 THEN 'severe' WHEN ham / spam > 3 THEN 'moderate' ELSE 'fine' END AS spam_severity,
  CASE WHEN ham / phishing > 5 THEN 'severe' WHEN ham / phishing > 3 THEN 'moderate' ELSE 'fine' END AS phishing_severity, greatest(ham, spam, phishing) > 3 * least(ham, spam, phishing) AS balance FROM n""")
def a02(spark, d):
    return Q.imbalance(V.labelled(spark, d))


@query("a03_length_stats", f"WITH {V.MESSAGES}, r AS (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) AS r, count(*) OVER () AS n FROM messages WHERE text IS NOT NULL) SELECT round_even(avg(len), 4) AS mean, max(len) FILTER (r = n // 2 + 1) AS median, min(len) AS shortest, max(len) AS longest FROM r")
def a03(spark, d):
    return Q.length_stats(V.messages(spark, d))


_ODD = lambda mark: f"(length(text) - length(replace(text, {mark}, ''))) % 2 = 1"


@query("a04_text_quality", rf"""WITH {V.NOISY} SELECT count(*) FILTER (coalesce(length(text), 0) = 0) AS empty_text, count(*) FILTER (length(text) BETWEEN 1 AND 4) AS too_short, count(*) FILTER (length(text) > 1000) AS too_long,
  count(*) FILTER (regexp_matches(text, '^\s*\p{{Nd}}+\s*$')) AS only_numbers, count(*) FILTER (regexp_matches(text, '^\s*[^\p{{L}}\p{{N}}\p{{M}}_\s]+\s*$')) AS only_punctuation,
  count(*) FILTER (contains(text, 'http://') OR contains(text, 'https://') OR contains(text, 'bit.ly') OR contains(text, 'tinyurl.com')) AS suspicious_urls, count(*) FILTER (contains(text, chr(65533))) AS encoding_issues,
  count(*) FILTER (length(text) > 0 AND ({_ODD("chr(34)")} OR {_ODD("chr(39)")})) AS malformed_quotes FROM noisy""")
def a04(spark, d):
    return Q.text_quality(V.noisy(spark, d))


_REPEATED = r"list_has_any([1], list_transform(list_filter(list_distinct(string_split(lower(text), '')), lambda x: x <> chr(10)), lambda x: CASE WHEN contains(lower(text), repeat(x, 5)) THEN 1 ELSE 0 END))"


@query("a05_suspicious_patterns", f"""WITH {V.NOISY} SELECT count(*) FILTER (regexp_matches(lower(text), 'test|sample|example')) AS test_messages, count(*) FILTER (regexp_matches(lower(text), 'lorem|ipsum|placeholder|dummy')) AS placeholder_text,
  count(*) FILTER (contains(lower(text), 'lorem ipsum')) AS lorem_ipsum, count(*) FILTER ({_REPEATED}) AS repeated_chars, 0::BIGINT AS all_caps, count(*) FILTER (contains(text, '  ')) AS excessive_spaces FROM noisy""")
def a05(spark, d):
    return Q.suspicious_patterns(V.noisy(spark, d))


@query("a06_language_distribution", f"WITH {V.NOISY}, s AS (SELECT {SCRIPT_SQL} AS script FROM noisy) SELECT script, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM s GROUP BY script")
def a06(spark, d):
    return Q.language_distribution(V.noisy(spark, d))


@query("a06_language_ranges", f"WITH {V.NOISY}, s AS (SELECT {RANGES_SQL} AS script FROM noisy) SELECT script, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM s GROUP BY script")
def a06_ranges(spark, d):
    return Q.language_distribution(V.noisy(spark, d), T.script_of_ranges)


@query("a07_quality_score", f"""WITH {V.MESSAGES}, a AS (SELECT count(*) AS duplicates FROM (SELECT text FROM messages GROUP BY text HAVING count(*) > 1)), b AS (SELECT count(*) FILTER (coalesce(length(text), 0) = 0) AS empty_text, count(*) FILTER (contains(text, chr(65533))) AS encoding_issues FROM messages)
  SELECT duplicates, empty_text, encoding_issues, round_even(greatest(0.0, least(100.0, 100 - 0.1::DOUBLE * duplicates - 0.5 * empty_text - 0.2 * encoding_issues)), 4)::DOUBLE AS score FROM a, b""")
def a07(spark, d):
    return Q.quality_score(V.messages(spark, d))


@query("a08_validate", f"""WITH {V.LABELLED}, odd AS (SELECT * REPLACE (CASE WHEN row_id % 50 = 0 THEN 'scam' ELSE label END AS label) FROM labelled)
  SELECT count(*) AS rows, count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (label IS NULL) AS null_label, count(*) FILTER (length(text) = 0) AS empty_text, count(*) FILTER (label = 'scam') AS n_invalid, 'scam' AS invalid_labels, count(text) - count(DISTINCT text) AS surplus, '' AS missing, false AS passed FROM odd""")
def a08(spark, d):
    return Q.validate(V.labelled(spark, d).withColumn("label", F.when(F.col("row_id") % 50 == 0, "scam").otherwise(F.col("label"))))


@query("a08_validate_without_label", f"""WITH {V.LABELLED} SELECT count(*) AS rows, count(*) FILTER (text IS NULL) AS null_text, 0::BIGINT AS null_label, count(*) FILTER (length(text) = 0) AS empty_text,
  0::BIGINT AS n_invalid, '' AS invalid_labels, count(text) - count(DISTINCT text) AS surplus, 'label' AS missing, false AS passed FROM labelled""")
def a08_missing(spark, d):
    return Q.validate(V.labelled(spark, d).drop("label"))


@query("a09_dataset_catalog", f"WITH {V.LABELLED}, n AS (SELECT category AS dataset, label, count(*) AS n FROM labelled GROUP BY ALL) SELECT dataset, sum(n)::BIGINT AS rows, string_agg(label || '=' || n, ',' ORDER BY label || '=' || n) AS labels FROM n GROUP BY dataset")
def a09(spark, d):
    return Q.dataset_catalog(V.labelled(spark, d).withColumnRenamed("category", "dataset"))


@query("a10_compare_datasets", f"WITH {V.LABELLED} SELECT category AS dataset, count(*) AS total, count(*) FILTER (label = 'ham') AS ham, count(*) FILTER (label = 'spam') AS spam, count(*) FILTER (label = 'phishing') AS phishing, round_even(avg(length(text)), 4) AS avg_length FROM labelled GROUP BY category")
def a10(spark, d):
    return Q.compare_datasets(V.labelled(spark, d).withColumnRenamed("category", "dataset"))


@query("a11_class_weights", f"WITH {V.LABELLED} SELECT label, count(*) AS n, round_even(sum(count(*)) OVER () / (3 * count(*)), 6) AS weight FROM labelled GROUP BY label")
def a11(spark, d):
    return Q.class_weights(V.labelled(spark, d))
