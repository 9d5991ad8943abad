"""The manifest against a tree built in plain Python, over odd rows, and numbering across partitions."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from msgloom.llm import merkle_manifest
from msgloom.llm._io import numbered
from tests.llm.test_jobs import SCHEMA, odd_rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree(nodes):
    """Levels from the nodes up to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        at = i // 3 * 3
        yield level[at:i], level[i + 1 : at + 3]
        i //= 3


def brute(rows):
    by = lambda r: "" if r[3] is None else "+" + r[3]
    rows = sorted(rows, key=lambda r: (by(r).encode(), r[0] is not None, r[0] or 0, leaf(r, r[1])))
    groups = [list(g) for _, g in groupby(rows, key=by)]
    trees = [tree([leaf(r, r[1]) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for s, (g, t) in enumerate(zip(groups, trees)):
        for i, r in enumerate(g):
            path = [*siblings(t, i), *siblings(top, s)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r, r[1].replace("\n", "") if hit else r[1])
            for left, right in path:
                node = h(*left, node, *right)
            out.append((r[0], leaf(r, r[1]), t[-1][0], top[-1][0], h(*(x for p in path for side in p for x in side)), node, node == top[-1][0]))
    return out


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 3, 4, 27, 243, 244, 1000])
def test_sizes(spark, n):
    rows = [(i, f"line {i}\nend", "en", "a" if i % 3 else None, i) for i in range(n)]
    got = plain(merkle_manifest.tampered_proofs(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)))
    assert got == sorted(brute(rows), key=str)
    assert {r[-1] for r in got} <= {True, False} and (n < 27 or len({r[-1] for r in got}) == 2)


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("tree", "block", "index", "digest", "path", "levels", "nodes", "_part")})
    assert plain(merkle_manifest.tampered_proofs(df)) == sorted(brute(rows), key=str)
    assert merkle_manifest.tampered_proofs(df.limit(0)).count() == 0


def test_many_sources(spark):
    rows = [(i, "x", None, f"s{i % 300}", 1) for i in range(700)]
    got = plain(merkle_manifest.tampered_proofs(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    assert got == sorted(brute(rows), key=str)


def test_numbered(spark):
    """Places run on through every partition that a group covers."""
    r = random.Random(1)
    rows = [(r.choice(["a", None, "b", "b", "b", "b", "b"]), r.randrange(50)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbered(df, "g", ["k"], "test-numbered").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    for g in ("a", "b", None):
        own = sorted((x["index"], x["k"]) for x in found if x["g"] == g)
        assert [i for i, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
    assert len(found) == 3000
