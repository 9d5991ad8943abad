"""Fixity audit of WARC replicas with Merkle trees.

Leaves are the SHA-256 digests of records. Over them stand nodes for ranges of a file (``RANGE_RECORDS`` record numbers,
whose records lie one behind another in the file), for whole files, and for groups of ``FAN_IN`` files (then groups of
groups) up to one root. A node's digest covers its children's numbers and digests in order; a range's covers the records'
numbers and lengths, too, and with them where each lies in the range. Every replica builds its tree from its own records
alone, once, as one written table a level.

Two replicas are compared from the root down: equal roots end the audit there. Otherwise each level is joined only for the
children of nodes that differ, and records are read and joined only in the ranges at the end of that descent. Their
offsets come from the bytes of the ranges in front of them.

Record bytes are hashed where they are read; only digests and lengths are shuffled. A file has at most
``RECORDS_PER_FILE`` record numbers by construction, which bounds every window and every node's list of children.

Defined cases: null url or html count as empty; record numbers are unique in the format, so rows that repeat one are hashed
together (count, smallest, largest and combined digest) into one leaf; a null number belongs to file -1 and is no other
record's; further columns are ignored; equal replicas and empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from msgloom.llm._io import materialize, passing

RECORDS_PER_FILE, RANGE_RECORDS, FAN_IN = 4096, 64, 16


def warc_record(record_id: Column, url: Column, html: Column) -> Column:
    """The bytes of one WARC response record."""
    body = F.coalesce(html, F.lit(""))
    head = [F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), record_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit(""))]
    return F.concat(*head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """``warc_file, range, page_id, length, digest``: one row per record number."""
    record = warc_record(F.coalesce("page_id", F.lit(-1)), F.col("url"), F.col("html"))
    one = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(record.cast("binary"), 256).alias("digest"), F.octet_length(record).cast("long").alias("length"))
    part = lambda n: F.coalesce(F.floor(F.col("page_id") / n), F.lit(-1)).cast("long")
    words = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(8)]
    same = one.groupBy(part(RECORDS_PER_FILE).alias("warc_file"), part(RANGE_RECORDS).alias("range"), "page_id")
    same = same.agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.min("digest").alias("low"), F.max("digest").alias("high"), *(F.sum(w).alias(f"w{k}") for k, w in enumerate(words)))
    joint = F.sha2(F.concat_ws("|", "n", "low", "high", *(f"w{k}" for k in range(8))), 256)
    return same.select("warc_file", "range", "page_id", "length", F.when(F.col("n") == 1, F.col("low")).otherwise(joint).alias("digest"))


def _nodes(children: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``keys, digest, length``: one digest over the children's ``order`` columns and digests, and their bytes."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "digest")))
    text = F.transform(listed, lambda x: F.concat_ws(":", *(F.coalesce(x[c].cast("string"), F.lit("-")) for c in order), x["digest"]))
    return children.groupBy(*keys).agg(F.sha2(F.array_join(text, "\n").cast("binary"), 256).alias("digest"), F.sum("length").alias("length"))


def _parent() -> Column:
    """The group of a node; file -1 belongs to the first, so that all groups end in one root."""
    return F.floor((F.col("node") + 1) / FAN_IN)


def tree(own: DataFrame) -> list[DataFrame]:
    """The written tables of a replica's tree over its (written) leaves: the root's, groups of files down to files, ranges."""
    ranges = materialize(_nodes(own, ["warc_file", "range"], ["page_id", "length"]), "fixity-ranges")
    files = _nodes(ranges, ["warc_file"], ["range"]).withColumnRenamed("warc_file", "node")
    out = [ranges, materialize(files.withColumn("parent", _parent()), "fixity-files")]
    while out[-1].select("parent").distinct().limit(2).count() > 1 or len(out) < 3:
        up = _nodes(out[-1], ["parent"], ["node"]).withColumnRenamed("parent", "node")
        up = up.withColumn("parent", _parent())
        out.append(materialize(up, "fixity-groups"))
    return out[::-1]


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side under ``keys`` (null is a key, too) that the other side lacks or has with another digest."""
    x = a.select(*(F.col(k).alias(f"{k}_a") for k in keys), *(F.col(c).alias(f"{c}_a") for c in a.columns if c not in keys))
    y = b.select(*(F.col(k).alias(f"{k}_b") for k in keys), F.col("digest").alias("digest_b"))
    on = reduce(lambda p, q: p & q, (F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b")) for k in keys))
    joined = x.join(y, on, "full_outer").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    return joined.withColumns({k: F.coalesce(f"{k}_a", f"{k}_b") for k in keys}).drop(*(f"{k}_{s}" for k in keys for s in "ab"))


def _within(level: DataFrame, suspects: DataFrame, *keys: str) -> DataFrame:
    return level.join(suspects, list(keys), "left_semi")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records of ``replica`` that are changed, missing or extra against ``primary``, with their place in the primary's files."""
    with passing() as keep:
        return keep(materialize(_audit(primary, replica), "fixity-found"))


def _audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    a, b = materialize(leaves(primary), "fixity-a"), materialize(leaves(replica), "fixity-b")
    above_a, above_b = tree(a), tree(b)
    while len(above_a) != len(above_b):  # the lower tree gets further levels of one node
        low = min(above_a, above_b, key=len)
        low.insert(0, materialize(_nodes(low[0], ["parent"], ["node"]).withColumnRenamed("parent", "node").withColumn("parent", _parent()), "fixity-groups"))
    suspects = materialize(_differing(above_a[0].select("node", "digest"), above_b[0].select("node", "digest"), ["node"]).select("node"), "fixity-suspects")
    kinds = "page_id long, warc_file long, offset long, length long, kind string, digest_a string, digest_b string"
    if not suspects.take(1):
        return primary.sparkSession.createDataFrame([], kinds)
    for x, y in zip(above_a[1:-1], above_b[1:-1]):
        below = suspects.withColumnRenamed("node", "parent")
        x, y = (_within(t, below, "parent").select("node", "digest") for t in (x, y))
        suspects = materialize(_differing(x, y, ["node"]).select("node"), "fixity-suspects")
    files = suspects.withColumnRenamed("node", "warc_file")
    ranges_a, ranges_b = (_within(t[-1], files, "warc_file") for t in (above_a, above_b))
    hit = materialize(_differing(ranges_a.select("warc_file", "range", "digest"), ranges_b.select("warc_file", "range", "digest"), ["warc_file", "range"]).select("warc_file", "range"), "fixity-suspects")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges_a.select("warc_file", "range", F.coalesce(F.sum("length").over(before("warc_file", "range")), F.lit(0)).alias("start"))
    own = _within(a, hit, "warc_file", "range").join(starts, ["warc_file", "range"])
    own = own.withColumn("offset", (F.col("start") + F.coalesce(F.sum("length").over(before("warc_file", "range", "page_id")), F.lit(0))).cast("long"))
    found = _differing(own.select("warc_file", "page_id", "offset", "length", "digest"), _within(b, hit, "warc_file", "range").select("warc_file", "page_id", "digest"), ["warc_file", "page_id"])
    kind = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return found.select("page_id", "warc_file", F.col("offset_a").alias("offset"), F.col("length_a").alias("length"), kind.alias("kind"), "digest_a", "digest_b")


def damaged(pages: DataFrame) -> DataFrame:
    """A second copy of ``pages`` with known damage: a changed letter, a cut end, and lost records."""
    html = F.when(F.col("page_id") % 499 == 5, F.concat(F.lit("~"), F.substring("html", 2, 1 << 30)))
    html = html.when(F.col("page_id") % 701 == 11, F.substring(F.col("html"), F.lit(1), F.floor(F.length("html") / 2).cast("int"))).otherwise(F.col("html"))
    return pages.filter(F.coalesce(F.col("page_id") % 997 != 7, F.lit(True))).withColumn("html", html)


ORACLE_SQL = f"""
WITH copies AS (
  SELECT page_id, url, coalesce(html, '') AS a, page_id % 997 = 7 AS lost,
    CASE WHEN page_id % 499 = 5 THEN '~' || substr(coalesce(html, ''), 2) WHEN page_id % 701 = 11 THEN substr(coalesce(html, ''), 1, length(html) // 2) ELSE coalesce(html, '') END AS b
  FROM pages),
records AS (
  SELECT page_id, lost, {{0}} AS ra, {{1}} AS rb FROM copies),
placed AS (
  SELECT page_id, lost, page_id // {RECORDS_PER_FILE} AS warc_file, strlen(ra) AS length, sha256(ra) AS digest_a, CASE WHEN lost THEN NULL ELSE sha256(rb) END AS digest_b,
    coalesce(sum(strlen(ra)) OVER (PARTITION BY page_id // {RECORDS_PER_FILE} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM records)
SELECT page_id, warc_file, "offset", length::BIGINT AS length, CASE WHEN lost THEN 'missing' ELSE 'changed' END AS kind, digest_a, digest_b
FROM placed WHERE digest_b IS DISTINCT FROM digest_a
"""
_CR = "chr(13) || chr(10)"
for _k, _c in enumerate("ab"):
    ORACLE_SQL = ORACLE_SQL.replace(f"{{{_k}}}", f"'WARC/1.0' || {_CR} || 'WARC-Type: response' || {_CR} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {_CR} || 'WARC-Target-URI: ' || coalesce(url, '') || {_CR} || 'Content-Length: ' || strlen({_c}) || {_CR} || {_CR} || {_c} || {_CR} || {_CR}")
