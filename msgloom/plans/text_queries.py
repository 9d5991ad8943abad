"""Registered queries of the text functions (T1 to T26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgloom.functions import text as T
from msgloom.plans import views as V
from msgloom.plans.registry import query



def _c():
    return F.col("text")


_LOW = "lower(text)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _of(view, name: str, expr, sql: str, with_: str, source: str, key: str = "row_id") -> None:
    """Register ``key`` and one computed column ``out`` over a view."""

    @query(name, f"WITH {with_} SELECT {key}, {sql} AS out FROM {source}")
    def run(spark, d):
        return view(spark, d).select(key, expr().alias("out"))


def _noisy(name: str, expr, sql: str) -> None:
    _of(V.noisy, name, expr, sql, V.NOISY, "noisy")


def _plain(name: str, expr, sql: str) -> None:
    _of(V.messages, name, expr, sql, V.MESSAGES, "messages")


_SPACE = r"[\s\x1C-\x1F\x85\p{Z}]+"
_SQUEEZE = rf"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"
_FOLD = f"translate(translate(nfc_normalize(text), {_q(T.INVISIBLE)}, ''), {_q(T.HOMOGLYPH_FROM)}, {_q(T.HOMOGLYPH_TO)})"
_ASCII = r"regexp_full_match(text, '[\x00-\x7F]*')"
_SUB = lambda c, p, r: f"regexp_replace({c}, {_q(p)}, {_q(r)}, 'g')"
_COUNT = lambda c, p: f"len(regexp_extract_all({c}, {_q(p)}))"

_noisy("t01_normalize_unicode", lambda: T.normalize_unicode(_c()), _FOLD)
_noisy("t02_normalize_fast", lambda: T.normalize_fast(_c()), f"CASE WHEN {_ASCII} THEN text ELSE {_FOLD} END")
_noisy("t03_clean_for_model", lambda: T.clean_for_model(_c()), _SUB(_SQUEEZE, T.EMOJI, "[EMOJI]"))
_noisy("t04_clean_text", lambda: T.clean_text(F.concat(F.lit(" 12|"), _c(), F.lit(" \\\\"))), _SUB(_SUB(rf"trim(regexp_replace(' 12|' || text || ' \\', '{_SPACE}', ' ', 'g'))", r"\\+$", ""), r"^\s*\d+\|", ""))
_MASKED = _SUB(_SUB(_SUB(_SUB(_SQUEEZE, T.URL, "[URL]"), r"\b\d{10,15}\b", "[PHONE]"), T.REDACTIONS["email_addresses"], "[EMAIL]"), r"[!?.]{2,}", "!")
_noisy("t05_mask_entities", lambda: T.mask_entities(_c()), f"trim({_MASKED})")

_URLS = f"list_transform(regexp_extract_all(text, {_q(T.URL)}), lambda u: lower(u))"
_HAS = lambda words: " OR ".join(f"contains(u, {_q(w)})" for w in words)
_URL_SQL = f"""len({_URLS})::BIGINT AS url_count, len(list_filter({_URLS}, lambda u: {_HAS(T.SHORTENERS)}))::BIGINT AS shortener_count,
  len(list_filter({_URLS}, lambda u: {_HAS(T.SUSPICIOUS_DOMAINS)}))::BIGINT AS suspicious_domain_count, {_COUNT('text', r'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')}::BIGINT AS ip_address_count"""
_RATIO = lambda p: f"({_COUNT('text', p)}::DOUBLE / greatest(length(text), 1))"
_HITS = " + ".join(f"(length({_LOW}) - length(replace({_LOW}, '{w}', ''))) // {len(w)}" for w in T.KEYWORDS)
_TEXT_SQL = f"""{_COUNT('text', T.EMOJI)}::BIGINT AS emoji_count, {_COUNT('text', T.SPECIAL)}::BIGINT AS special_char_count, {_RATIO(chr(92) + 'p{Lu}')} AS uppercase_ratio,
  {_RATIO(chr(92) + 'p{Nd}')} AS digit_ratio, ({_HITS})::BIGINT AS suspicious_keyword_count"""
FEATURES = f"{V.NOISY}, features AS (SELECT row_id, text, {_URL_SQL}, {_TEXT_SQL} FROM noisy)"
SCORE = """least(CASE WHEN url_count > 0 THEN 0.3 + CASE WHEN shortener_count > 0 THEN 0.4 ELSE 0 END + CASE WHEN suspicious_domain_count > 0 THEN 0.5 ELSE 0 END
  + CASE WHEN ip_address_count > 0 THEN 0.6 ELSE 0 END ELSE 0 END + CASE WHEN emoji_count > 2 THEN 0.2 ELSE 0 END + CASE WHEN special_char_count::DOUBLE / greatest(length(text), 1) > 0.1 THEN 0.1 ELSE 0 END
  + CASE WHEN uppercase_ratio > 0.3 THEN 0.1 ELSE 0 END + CASE WHEN suspicious_keyword_count > 3 THEN 0.2 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(text, '[^\\x00-\\x7F]'))::DOUBLE / greatest(length(text), 1) > 0.1 THEN 0.1 ELSE 0 END, 1.0)::DOUBLE"""


def _longs(struct: str, names: list[str]):
    return [F.col(f"{struct}.{n}").cast("long").alias(n) for n in names]


@query("t06_url_features", f"WITH {FEATURES} SELECT row_id, url_count, shortener_count, suspicious_domain_count, ip_address_count FROM features")
def t06(spark, d):
    return V.noisy(spark, d).select("row_id", T.url_features(_c()).alias("f")).select("row_id", *_longs("f", ["url_count", "shortener_count", "suspicious_domain_count", "ip_address_count"]))


@query("t07_text_features", f"WITH {FEATURES} SELECT row_id, emoji_count, special_char_count, round(uppercase_ratio, 9) AS uppercase_ratio, round(digit_ratio, 9) AS digit_ratio, suspicious_keyword_count FROM features")
def t07(spark, d):
    f = V.noisy(spark, d).select("row_id", T.text_features(_c()).alias("f"))
    return f.select("row_id", *_longs("f", ["emoji_count", "special_char_count", "suspicious_keyword_count"]), F.round("f.uppercase_ratio", 9).alias("uppercase_ratio"), F.round("f.digit_ratio", 9).alias("digit_ratio"))


@query("t08_adversarial_score", f"WITH {FEATURES} SELECT row_id, round({SCORE}, 6) AS score FROM features")
def t08(spark, d):
    f = V.noisy(spark, d).select("row_id", "text", T.url_features(_c()).alias("u"), T.text_features(_c()).alias("t"))
    return f.select("row_id", F.round(T.adversarial_score(_c(), F.col("u"), F.col("t")), 6).alias("score"))


@query("t09_preprocess", f"WITH {FEATURES.replace('FROM noisy)', f'FROM (SELECT row_id, CASE WHEN {_ASCII} THEN text ELSE {_FOLD} END AS text FROM noisy))')} SELECT row_id, text AS normalized, url_count, emoji_count, suspicious_keyword_count FROM features")
def t09(spark, d):
    f = V.noisy(spark, d).select("row_id", T.preprocess(_c()).alias("p"))
    return f.select("row_id", "p.normalized", *_longs("p.url", ["url_count"]), *_longs("p.features", ["emoji_count", "suspicious_keyword_count"]))


_plain("t10_text_hash", lambda: T.text_hash(_c()), "'sha256:' || sha256(text)")

_ORDER = ["email_addresses", "phone_numbers", "credit_cards", "ssn", "urls"]
_RE2 = {k: v.replace(r"\s", r"[\t-\r ]").replace("[-.[\\t-\\r ]]", r"[-.\t-\r ]").replace(r"[[\t-\r ]-]", r"[\t-\r -]").replace(r"[^[\t-\r ]]", r"[^\t-\r ]") for k, v in T.REDACTIONS.items()}
_STEPS, _PREVIOUS = [], "text"
for _i, _name in enumerate(_ORDER):
    _STEPS.append(f"s{_i} AS (SELECT *, {_SUB(_PREVIOUS, _RE2[_name], '[REDACTED]')} AS r{_i}, CASE WHEN regexp_matches({_PREVIOUS}, {_q(_RE2[_name])}) THEN '{_name}' END AS h{_i} FROM {'noisy' if _i == 0 else f's{_i - 1}'})")
    _PREVIOUS = f"r{_i}"
REDACTED = f"{V.NOISY}, {', '.join(_STEPS)}"


@query("t11_redact", f"WITH {REDACTED} SELECT row_id, r4 AS text, coalesce(h0, h1, h2, h3, h4) IS NOT NULL AS redaction_applied, nullif(concat_ws(',', h0, h1, h2, h3, h4), '') AS redacted_entities FROM s4")
def t11(spark, d):
    r = V.noisy(spark, d).select("row_id", T.redact(_c(), _ORDER).alias("r"))
    return r.select("row_id", "r.text", "r.redaction_applied", F.array_join("r.redacted_entities", ",").alias("redacted_entities"))


@query("t12_text_storage", f"WITH {REDACTED} SELECT row_id, CASE row_id % 4 WHEN 0 THEN CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END WHEN 1 THEN 'sha256:' || sha256(text) WHEN 2 THEN r4 ELSE text END AS out FROM s4")
def t12(spark, d):
    mode = F.get(F.array(*map(F.lit, ["truncated", "hash_only", "redacted", "anything"])), (F.col("row_id") % 4).cast("int"))
    return V.noisy(spark, d).select("row_id", T.apply_text_storage(_c(), mode, _ORDER).alias("out"))


_HOLES = " Hi <PERSON>, see <URL> and <URL> by <DATE_TIME> or call <PHONE_NUMBER>."


def _filled_sql(column: str) -> str:
    steps, previous = [f"f0 AS (SELECT row_id, text || '{_HOLES}' AS original, text || '{_HOLES}' AS x0 FROM messages)"], 0
    for k, (token, pool) in enumerate(T.PLACEHOLDERS.items(), 1):
        pick = f"{pool!r}[('0x' || substr(md5(original || '|{token}|' || (i - 1)), 1, 8))::BIGINT % {len(pool)} + 1]"
        steps.append(f"f{k} AS (SELECT row_id, original, array_to_string(list_transform(string_split(x{previous}, '{token}'), lambda x, i: CASE WHEN i = 1 THEN x ELSE {pick} || x END), '') AS x{k} FROM f{previous})")
        previous = k
    return f"WITH {V.MESSAGES}, {', '.join(steps)} SELECT row_id, x{previous} AS {column} FROM f{previous}"


@query("t13_fill_placeholders", _filled_sql("out"))
def t13(spark, d):
    return V.messages(spark, d).select("row_id", T.fill_placeholders(F.concat(_c(), F.lit(_HOLES))).alias("out"))


SCRIPT_SQL = r"CASE WHEN regexp_matches(text, '[а-яёА-ЯЁ]') THEN 'cyrillic' WHEN regexp_matches(text, '[\x{600}-\x{6FF}]') THEN 'arabic' WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'chinese' WHEN regexp_full_match(text, '[a-zA-Z\t-\r .,!?''""-]+') THEN 'english' ELSE 'other' END".replace('""', '"')
_noisy("t14_script_of", lambda: T.script_of(_c()), SCRIPT_SQL)
RANGES_SQL = rf"CASE WHEN {_ASCII} THEN 'english' WHEN regexp_matches(lower(text), '[\x{{400}}-\x{{4FE}}]') THEN 'cyrillic' WHEN regexp_matches(lower(text), '[\x{{600}}-\x{{6FE}}]') THEN 'arabic' WHEN regexp_matches(lower(text), '[\x{{4E00}}-\x{{9FFE}}]') THEN 'chinese' ELSE 'other' END"
_noisy("t15_script_of_ranges", lambda: T.script_of_ranges(_c()), RANGES_SQL)
_BARE = _SUB(_SUB(_SUB("text", r"https?://[^\t-\r ]+", ""), r"\p{Nd}+", ""), r"[^\p{L}\p{N}_\t-\r ]", "")
_noisy("t16_is_english", lambda: T.is_english(_c()), rf"""length(trim(text)) >= 3 AND NOT regexp_matches(text, '[\x{{590}}-\x{{6FF}}\x{{400}}-\x{{4FF}}\x{{980}}-\x{{AFF}}\x{{B80}}-\x{{BFF}}]') AND length(trim({_BARE})) >= 3 AND {_COUNT(_BARE, chr(92) + 'p{L}')} > 0
  AND {_COUNT(_BARE, '[A-Za-z]')} > 0.9 * {_COUNT(_BARE, chr(92) + 'p{L}')} AND regexp_matches(lower({_BARE}), '(^|[^\p{{L}}\p{{N}}_])({'|'.join(T.ENGLISH_WORDS)})([^\p{{L}}\p{{N}}_]|$)')""")
_noisy("t17_is_pure_english", lambda: T.is_pure_english(_c()), rf"""{_ASCII} AND length(trim(text)) >= 5 AND len(list_filter(regexp_split_to_array(text, '[\t-\r ]+'), lambda x: x <> '')) >= 3
  AND ({' OR '.join(f"contains(regexp_replace({_LOW}, '[^a-z0-9_{chr(92)}t-{chr(92)}r ]', '', 'g'), '{w}')" for w in T.PLAIN_ENGLISH)})""")


@query("t18_decode_payload")
def t18(spark, d):
    """Payloads of four charsets made from messages, decoded back."""
    code = F.get(F.array(*map(F.lit, [0, 8, 6, 7, 14])), (F.col("row_id") % 5).cast("int"))
    raw = F.when(code == 8, F.encode(_c(), "UTF-16BE")).otherwise(F.encode(_c(), "UTF-8"))
    m = V.messages(spark, d).withColumn("code", code).withColumn("raw", raw)
    short = F.when(F.col("row_id") % 2 == 0, F.col("raw"))
    return m.select("row_id", "code", T.decode_payload(short, F.col("raw"), F.col("code")).alias("out"))


@query("t19_unclassifiable_reason", f"WITH {V.AUDIT} SELECT event_id, CASE WHEN event_id % 7 = 0 AND event_id % 5 >= 4 THEN 'national_language_table' WHEN event_id % 16 IN (4, 9, 5, 10, 13) THEN printf('data_coding_0x%02X', event_id % 16) END AS out FROM audit")
def t19(spark, d):
    e = V.audit(spark, d).select("event_id")
    udh = F.when(F.col("event_id") % 7 == 0, F.array(F.unhex(F.concat(F.lit("24010"), (F.col("event_id") % 5).cast("string")))))
    return e.select("event_id", T.unclassifiable_reason(udh, F.col("event_id").cast("int")).alias("out"))


@query("t20_validate_request", rf"WITH {V.MESSAGES} SELECT row_id, CASE WHEN length(text) BETWEEN 1 AND 512 THEN regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g') END AS text, CASE WHEN coalesce(length(text), 0) < 1 THEN 'empty' WHEN length(text) > 512 THEN 'too_long' END AS reason FROM messages")
def t20(spark, d):
    return V.messages(spark, d).select("row_id", T.validate_request(_c()).alias("r")).select("row_id", "r.text", "r.reason")


@query("t21_parse_event_time", f"WITH {V.AUDIT} SELECT event_id, date_trunc('second', timestamp) AS out FROM audit")
def t21(spark, d):
    a = V.audit(spark, d)
    written = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "+00:00Z").when(F.col("event_id") % 3 == 1, "Z").otherwise("+00:00"))
    return a.select("event_id", T.parse_event_time(written).cast("timestamp_ntz").alias("out"))


PRIORITY = "CASE entry_type WHEN 'access_denied' THEN 'high' WHEN 'system_event' THEN CASE WHEN event_type LIKE '%error%' THEN 'high' WHEN event_type IN ('startup', 'shutdown') THEN 'medium' ELSE 'low' END WHEN 'prediction' THEN CASE WHEN label = 'phishing' THEN 'medium' ELSE 'low' END ELSE CASE WHEN thumbs_down THEN 'medium' ELSE 'low' END END"


def priority():
    return T.event_priority(F.col("entry_type"), F.col("label"), F.col("thumbs_down"), F.col("event_type"))


@query("t22_event_priority", f"WITH {V.AUDIT} SELECT event_id, {PRIORITY} AS out FROM audit")
def t22(spark, d):
    return V.audit(spark, d).select("event_id", priority().alias("out"))


_MOOD = "CASE WHEN thumbs_up THEN 'positive' WHEN thumbs_down THEN 'negative' ELSE 'neutral' END"
TITLE = f"CASE entry_type WHEN 'prediction' THEN 'Text Classification: ' || label WHEN 'feedback' THEN 'User Feedback: ' || {_MOOD} WHEN 'access_denied' THEN 'Access Denied: ' || endpoint ELSE 'System Event: ' || event_type END"
DESCRIPTION = f"""CASE entry_type WHEN 'prediction' THEN 'Message classified as ''' || label || ''' by ' || model || ' with ' || printf('%.2f', confidence * 100) || '% confidence'
  WHEN 'feedback' THEN 'User submitted ' || {_MOOD} || ' feedback (ID: ' || feedback_id || ')' WHEN 'access_denied' THEN 'Access denied to ' || endpoint || ': ' || reason
  ELSE CASE WHEN message <> '' THEN message ELSE 'System event of type ' || event_type END END"""


@query("t23_event_title_description", f"WITH {V.AUDIT} SELECT event_id, {TITLE} AS title, {DESCRIPTION} AS description FROM audit")
def t23(spark, d):
    a = V.audit(spark, d)
    x = a.select("event_id", T.event_title_description({c: F.col(c) for c in a.columns}).alias("x"))
    return x.select("event_id", "x.title", "x.description")


_plain("t24_message_structure", lambda: T.message_structure(_c()), f"CASE WHEN {' OR '.join(f'starts_with({_LOW}, {_q(w)})' for w in T.GREETINGS)} THEN 'greeting' WHEN {' OR '.join(f'contains({_LOW}, {_q(w)})' for w in T.QUESTIONS)} THEN 'question' WHEN {_LOW} LIKE '%!' OR {_LOW} LIKE '%.' THEN 'statement' WHEN {' OR '.join(f'contains({_LOW}, {_q(w)})' for w in T.COMMANDS)} THEN 'command' ELSE 'other' END")

#: A small dictionary over words of the test texts.
DICTIONARY = {"the": ["le", "la"], "and": ["et"], "is": ["est"], "for": ["pour"], "with": ["avec"], "want": ["vouloir"], "carry": ["porter"], "house": ["maison"]}
_VALUES = ", ".join(f"{k!r}: {v!r}" for k, v in DICTIONARY.items())


@query("t25_dictionary_translate", rf"""WITH {V.MESSAGES}, words AS (SELECT row_id, generate_subscripts(tokens, 1) - 1 AS i, unnest(tokens) AS token FROM (SELECT row_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') AS tokens FROM messages)),
  found AS (SELECT *, lower(token) AS low, MAP {{{_VALUES}}} AS m FROM words),
  picked AS (SELECT row_id, i, token, coalesce(m[low], m[regexp_replace(low, 'ing$', '')], m[regexp_replace(low, 'ied$', 'y')], m[regexp_replace(low, 'ed$', '')], m[regexp_replace(low, 's$', '')]) AS v FROM found),
  joined AS (SELECT row_id, string_agg(coalesce(v[('0x' || substr(md5(token || '|' || i), 1, 8))::BIGINT % len(v) + 1], token), ' ' ORDER BY i) AS out FROM picked GROUP BY row_id)
  SELECT m.row_id, coalesce(out, '') AS out FROM messages m LEFT JOIN joined USING (row_id)""")
def t25(spark, d):
    return V.messages(spark, d).select("row_id", T.dictionary_translate(_c(), DICTIONARY).alias("out"))


@query("t26_batch_bucket", f"WITH {V.BATCHES} SELECT size, CASE WHEN size <= 1 THEN 1 ELSE pow(2, ceil(log2(size)))::BIGINT END AS bucket, count(*) AS n FROM batches GROUP BY ALL")
def t26(spark, d):
    return V.batches(spark, d).select("size", T.batch_bucket(F.col("size")).alias("bucket")).groupBy("size", "bucket").agg(F.count("*").alias("n"))
