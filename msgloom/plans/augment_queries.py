"""Registered queries of augmentation and synthetic data (G1-G11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgloom.operators import augment as G
from msgloom.plans import views as V
from msgloom.plans.registry import query

_H = lambda *parts: f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"
_U = lambda *parts: f"({_H(*parts)} / 4294967296.0)"
_PICK = lambda values, *parts: f"{values!r}[{_H(*parts)} % {len(values)} + 1]"
_S = lambda x: f"'{x}'"


def _letters(text: str, name: str, key: str, then: str, share: float) -> str:
    """SQL that maps each letter ``x`` (at ``i``, from 0) of ``text`` to ``then`` with a chance."""
    return f"array_to_string(list_transform(list_filter(string_split({text}, ''), lambda y: y <> ''), lambda x, i: CASE WHEN {_U(_S(name), key, '(i - 1)')} < {share} THEN {then} ELSE x END), '')"


_FROM, _TO = "".join(G.LOOKALIKES), "".join(G.LOOKALIKES.values())
HOMOGLYPH = lambda key: _letters("lower(text)", "homoglyph", key, f"translate(x, '{_FROM}', '{_TO}')", 0.3)
_LEET = lambda key: _letters("text", "leet", key, f"translate(x, '{G.LEET_FROM}', '{G.LEET_TO}')", 0.2)


def typo(key: str, source: str) -> str:
    at = f"({_H(_S('place'), key)} % greatest(length(l), 1) + 1)"
    u = _U(_S("edit"), key)
    return f"(SELECT *, CASE WHEN {u} < 0.1 AND length(l) > 5 THEN substr(l, 1, {at} - 1) || substr(l, {at} + 1) WHEN {u} >= 0.1 AND {u} < 0.2 THEN substr(l, 1, {at}) || {_PICK(list('etaoin'), _S('letter'), key)} || substr(l, {at} + 1) ELSE l END AS typo FROM (SELECT *, {_LEET(key)} AS l FROM {source}))"


EMOJI = lambda key: f"array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN {_U(_S('emoji'), key, '(i - 1)')} < 0.4 THEN w || ' ' || {_PICK(G.EMOJI, _S('which'), key, '(i - 1)')} ELSE w END), ' ')"
CONTEXT = lambda key: f"CASE label {' '.join(f'WHEN {_S(k)} THEN {_PICK(v, _S(chr(99) + chr(111) + chr(110) + chr(116) + chr(101) + chr(120) + chr(116)), key)}' for k, v in G.PREFIXES.items())} END || text"


def _labelled(spark, d):
    return V.labelled(spark, d)


@query("g01_generate_from_templates", f"""WITH {V.LABELLED}, k AS (SELECT copy, label, label || ':' || copy AS key FROM range((SELECT count(*) FROM labelled)) r(copy), (VALUES ('ham'), ('spam'), ('phishing')) l(label)), t AS (SELECT copy, label, key, CASE label {' '.join(f'WHEN {_S(a)} THEN {_PICK(b, _S("template"), "key")}' for a, b in G.TEMPLATES.items())} END AS t FROM k)
  SELECT copy, label, replace(replace(replace(t, '{{name}}', {_PICK(G.POOLS['name'], _S('name'), 'key')}), '{{time}}', {_PICK(G.POOLS['time'], _S('time'), 'key')}), '{{amount}}', {_PICK(G.POOLS['amount'], _S('amount'), 'key')}) AS text FROM t""")
def g01(spark, d):
    """As many rows of each label as there are labelled messages."""
    return G.generate_from_templates(spark, _labelled(spark, d).count())


_BUILDER_ROWS = ", ".join(f"('{a}', '{b}', '{c}', '{t}')" for a, own in G.BUILDERS.items() for b, texts in own.items() for c, t in texts.items())


@query("g02_synthesize", f"""WITH {V.MESSAGES}, b(label, builder, lang, t) AS (VALUES {_BUILDER_ROWS}), l AS (SELECT DISTINCT language FROM messages), g AS (SELECT DISTINCT label, builder FROM b),
  x AS (SELECT g.label, g.builder, l.language, c.c AS copy, coalesce(own.t, en.t) AS t, g.label || ':' || g.builder || ':' || l.language || ':' || c.c AS key FROM g, l, range(1, 6) c(c) LEFT JOIN b own ON own.label = g.label AND own.builder = g.builder AND own.lang = l.language JOIN b en ON en.label = g.label AND en.builder = g.builder AND en.lang = 'en')
  SELECT DISTINCT label, replace(replace(replace(t, '{{name}}', {_PICK(G.POOLS['name'], _S('name'), 'key')}), '{{time}}', {_PICK(G.POOLS['time'], _S('time'), 'key')}), '{{amount}}', {_PICK(G.POOLS['amount'], _S('amount'), 'key')}) AS text FROM x""")
def g02(spark, d):
    return G.synthesize(V.messages(spark, d).select("language").distinct(), 5)


@query("g03_homoglyph_variant", f"WITH {V.MESSAGES} SELECT row_id, {HOMOGLYPH('row_id')} AS out FROM messages")
def g03(spark, d):
    return V.messages(spark, d).select("row_id", G.homoglyph_variant(F.col("text"), F.col("row_id")).alias("out"))


@query("g04_typo_variant", f"WITH {V.MESSAGES} SELECT row_id, typo AS out FROM {typo('row_id', 'messages')}")
def g04(spark, d):
    return V.messages(spark, d).select("row_id", G.typo_variant(F.col("text"), F.col("row_id")).alias("out"))


@query("g05_emoji_variant", f"WITH {V.MESSAGES} SELECT row_id, {EMOJI('row_id')} AS out FROM messages")
def g05(spark, d):
    return V.messages(spark, d).select("row_id", G.emoji_variant(F.col("text"), F.col("row_id")).alias("out"))


@query("g06_context_variant", f"WITH {V.LABELLED} SELECT row_id, {CONTEXT('row_id')} AS out FROM labelled")
def g06(spark, d):
    return _labelled(spark, d).select("row_id", G.context_variant(F.col("text"), F.col("label"), F.col("row_id")).alias("out"))


_LINKED = " http://shop.example.com/deal and https://bit.ly/x1"


@query("g07_url_variant", f"""WITH {V.MESSAGES} SELECT row_id, text || ' ' || {_PICK(G.SHORT_HOSTS, _S('host'), 'row_id', _S('http://shop.example.com/deal'))} || substr(md5(row_id || '|http://shop.example.com/deal'), 1, 7) || ' and https://bit.ly/x1' AS out FROM messages""")
def g07(spark, d):
    return V.messages(spark, d).select("row_id", G.url_variant(F.concat("text", F.lit(_LINKED)), F.col("row_id")).alias("out"))


_SPLIT = lambda c: f"list_filter(string_split({c}, ''), lambda y: y <> '')"


@query("g08_spaced_out", f"WITH {V.MESSAGES} SELECT row_id, array_to_string({_SPLIT('text')}, chr(8203)) AS zero_width, translate(text, '{G.LEET_FROM}', '{G.LEET_TO}') AS leet, array_to_string({_SPLIT(chr(114) + 'eplace(text, ' + _S(' ') + ', ' + _S('') + ')')}, ' ') AS spaced FROM messages")
def g08(spark, d):
    t = F.col("text")
    return V.messages(spark, d).select("row_id", G.zero_width(t).alias("zero_width"), G.leet(t).alias("leet"), G.spaced(t).alias("spaced"))


_AUGMENTED = f"""{V.LABELLED}, a AS (SELECT row_id, text, label, copy, row_id || ':' || copy AS key FROM labelled, range(3) c(copy)), k AS (SELECT *, CASE WHEN copy = 0 THEN 'original' ELSE {_PICK(G.TYPES, _S('type'), 'key')} END AS augmentation_type FROM a),
  augmented AS (SELECT row_id, label, copy, augmentation_type, CASE augmentation_type WHEN 'homoglyph' THEN {HOMOGLYPH('key')} WHEN 'typo' THEN typo WHEN 'emoji' THEN {EMOJI('key')} WHEN 'context' THEN {CONTEXT('key')} ELSE text END AS text FROM {typo('key', 'k')})"""


@query("g09_augment", f"WITH {_AUGMENTED} SELECT row_id, copy::INTEGER AS copy, augmentation_type, label, text FROM augmented")
def g09(spark, d):
    return G.augment(_labelled(spark, d)).select("row_id", "copy", "augmentation_type", "label", "text")


@query("g09_augmentation_counts", f"WITH {_AUGMENTED} SELECT augmentation_type, count(*) AS n FROM augmented GROUP BY ALL")
def g09_counts(spark, d):
    return G.augmentation_counts(G.augment(_labelled(spark, d)))


@query("g10_augment_corpus", f"""WITH {_AUGMENTED}, p AS (SELECT row_id * 3 + copy AS row_id, text, label FROM augmented), made AS (SELECT -1 - i * 3 - q AS row_id, label, label || ':' || i AS key FROM range(20) r(i), (VALUES ('ham', 1), ('spam', 2), ('phishing', 3)) l(label, q)),
  t AS (SELECT row_id, label, key, CASE label {' '.join(f'WHEN {_S(a)} THEN {_PICK(b, _S("template"), "key")}' for a, b in G.TEMPLATES.items())} END AS t FROM made),
  u AS (SELECT row_id, text, label FROM p UNION ALL SELECT row_id, replace(replace(replace(t, '{{name}}', {_PICK(G.POOLS['name'], _S('name'), 'key')}), '{{time}}', {_PICK(G.POOLS['time'], _S('time'), 'key')}), '{{amount}}', {_PICK(G.POOLS['amount'], _S('amount'), 'key')}), label FROM t)
  SELECT min(row_id) AS row_id, text, arg_min(label, row_id) AS label FROM u GROUP BY text""")
def g10(spark, d):
    return G.augment_corpus(_labelled(spark, d), factor=2).select("row_id", "text", "label")


_ALLOCATED = f"""{V.LABELLED}, n AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total, max(count(*)) OVER () AS top FROM labelled GROUP BY label), f AS (SELECT *, floor((3 * total - total) * n / total)::BIGINT AS part FROM n)"""


_TEMPLATED = f"""replace(replace(replace(t, '{{name}}', {_PICK(G.POOLS['name'], _S('name'), 'key')}), '{{time}}', {_PICK(G.POOLS['time'], _S('time'), 'key')}), '{{amount}}', {_PICK(G.POOLS['amount'], _S('amount'), 'key')})"""


@query("g11_expand_to", f"""WITH {_ALLOCATED}, new AS (SELECT label, (part + CASE WHEN n = top THEN 2 * total - sum(part) OVER () ELSE 0 END)::BIGINT AS new FROM f),
  k AS (SELECT label, label || ':' || copy AS key FROM (SELECT label, unnest(range(1, new + 1)) AS copy FROM new)), t AS (SELECT label, key, CASE label {' '.join(f'WHEN {_S(a)} THEN {_PICK(b, _S("template"), "key")}' for a, b in G.TEMPLATES.items())} END AS t FROM k)
  SELECT text, label, 'original' AS kind FROM labelled UNION ALL SELECT {_TEMPLATED}, label, 'template' FROM t UNION ALL SELECT NULL, label, 'synonym' FROM labelled, range(2)""")
def g11(spark, d):
    """Three times the corpus, and two synonym variants of each row (whose texts RE2 can't express: word limits go by Unicode)."""
    x = _labelled(spark, d)
    return G.expand_to(x, 3 * x.count()).withColumn("text", F.when(F.col("kind") != "synonym", F.col("text")))
