"""URL rules through a blocked Bloom filter and an exact hash join.

1. Every rule (host, path) is listed under its canonical key ``host + path`` and set in a split-block Bloom filter:
   256-bit blocks of eight 32-bit words, one bit in each word. Its size follows the number of rules up to
   ``MOST_BLOCKS``, so the broadcast is at most 16 MB whatever the list; a fuller filter only passes more candidates.
2. Each url gives the keys of its host and parent domains with its path's prefixes of the lengths that rules have.
   Keys that the filter rules out are dropped where the page is read; most pages leave here.
3. The remaining keys are hash-joined with the rules (which removes false positives) and the longest rule wins.

Only page ids, hosts and paths are shuffled. A host with a third of all pages makes one hot join key; the rules are
broadcast by Spark when small, and otherwise adaptive execution splits that key.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule, and the default verdict; repeated
rows give repeated rows; rules with equal keys: ``block`` wins; no rules: every page gets the default verdict; an empty
path starts with no rule's ``/``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm._io import buffer_of, materialize, passing

MOST_BLOCKS = 1 << 19
KEYS_PER_BLOCK = 16
#: Fixed odd multipliers, one for each word of a block.
WORD_SALTS = np.asarray([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """The host after the first ``://``, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to a query or fragment."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def candidate_keys(host: Column, path: Column, hosts: list[int], lengths: list[int]) -> Column:
    """``host + path`` keys of all rules that could fit: the host and its parent domains as long as a rule's host, each with the path prefixes as long as a rule's path."""
    if not lengths:
        return F.array().cast("array<string>")
    size = F.length(host)
    parent = lambda n: (size > n) & (F.substring(host, size - n, F.lit(1)) == ".")
    ends = F.array_compact(F.array(*(F.when((size == n) | parent(n), F.right(host, F.lit(n))) for n in hosts)))
    prefixes = F.array_compact(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)))
    return F.flatten(F.transform(ends, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def _hashes(keys: pa.Array) -> np.ndarray:
    from msgloom.llm.pieces import span_hashes

    data, offsets = buffer_of(keys)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    return span_hashes(data, offsets[:-1], offsets[1:])


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's block, and its eight one-bit words."""
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    block = (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
    return block, np.uint32(1) << ((low[:, None] * WORD_SALTS[None, :]) >> np.uint32(27))


def bloom_filter(keys: DataFrame, blocks: int) -> np.ndarray:
    """The filter's words for the strings in ``key``: each task sets its own bits, blocks are joined by OR."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bits = _bits(_hashes(batch.column("key")), blocks)
            at = (block[:, None] * 8 + np.arange(8)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.reshape(-1).astype(np.int64))], ["word", "bits"])

    words = keys.select("key").mapInArrow(build, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(blocks * 8, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.reshape(blocks, 8)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every page; ``rules`` has ``host, path, action``."""
    with passing() as keep:
        return keep(materialize(_judged(pages, rules, id_col, default), "url-verdicts"))


def _judged(pages: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    spark = pages.sparkSession
    listed = rules.select(F.concat("host", "path").alias("key"), "action", F.length("path").alias("n"), F.length("host").alias("h")).filter("key is not null")
    size = listed.agg(F.count("*"), F.collect_set("n"), F.collect_set("h")).first()  # lengths: as many as the longest path and host at most
    blocks = 1
    while blocks * KEYS_PER_BLOCK < size[0] and blocks < MOST_BLOCKS:
        blocks *= 2
    words = spark.sparkContext.broadcast(bloom_filter(listed, blocks))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = words.value
        for batch in batches:
            keys = batch.column("keys")
            flat, starts = keys.flatten(), keys.offsets.to_numpy().astype(np.int64)
            starts = starts - starts[0]
            if len(flat):
                block, bits = _bits(_hashes(flat), blocks)
                passed = ((filled[block] & bits) == bits).all(axis=1)
            else:
                passed = np.zeros(0, bool)
            before = np.concatenate([[0], np.cumsum(passed)])
            hits = pa.ListArray.from_arrays(pa.array(before[starts].astype(np.int32)), flat.filter(pa.array(passed)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, "host", "path")), hits], [id_col, "host", "path", "hits"])

    parsed = pages.select(id_col, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    keyed = parsed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), sorted(size[2]), sorted(size[1])))
    kind = pages.schema[id_col].dataType.simpleString()
    tested = keyed.mapInArrow(possible, f"`{id_col}` {kind}, host string, path string, hits array<string>").withColumn("row", F.monotonically_increasing_id())
    tested = materialize(tested, "url-hits")
    none = tested.filter(F.size("hits") == 0).select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    exact = listed.groupBy("key").agg(F.max("action").alias("action"))
    best = F.max(F.when(F.col("action").isNotNull(), F.struct(F.length("key").alias("n"), "key", "action")))
    some = tested.filter(F.size("hits") > 0).select("row", id_col, "host", "path", F.explode("hits").alias("key")).join(exact, "key", "left")
    some = some.groupBy("row", id_col, "host", "path").agg(best.alias("best"))
    return none.unionByName(some.select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")))


#: The rules of the registered query: host, path, action.
QUERY_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY_RULES, "host string, path string, action string")


ORACLE_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(host, path, action) AS (VALUES {', '.join(repr(r) for r in QUERY_RULES)}),
fits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.action FROM parsed p LEFT JOIN rules r
         ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(action, length(rule)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
"""
