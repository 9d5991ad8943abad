"""Divergence rules: counts and distances against plain Python, verdicts on labelled documents, odd rows."""

import random
import re
from collections import Counter
from math import log2, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgloom.llm import divergence
from tests.llm.test_jobs import SCHEMA, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def plain(rows):
    return sorted(rows, key=str)


def test_counts_of_odd_rows(spark):
    rows = odd_rows() + [(60, "a b c a b c\n\n x \n x \nx", "en", "s", 1, None, None, None, None), (61, "né né né né\r\nné né né né", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("classes", "slots", "counts", "n_words", "word", "n")})
    got = divergence.quality(df.repartition(3)).collect()
    assert plain((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got) == plain((r[0], *base(r[1])) for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert divergence.quality(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_labelled(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in divergence.quality(docs).join(labels, "doc_id").collect() if not r["base_failed"]]
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert all(good) and sum(bad) <= 0.2 * len(bad)


def test_rules_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (plain(tuple(r)[:8] for r in divergence.quality(docs.repartition(k)).collect()) for k in (1, 9))
    assert one == many


def jensen_shannon(p, q):
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p | q}
    side = lambda x: sum(v * log2(v / m[k]) for k, v in x.items() if v)
    return sqrt(max((side(p) + side(q)) / 2, 0))


def test_distances():
    r = random.Random(2)
    common = np.array([[0.2, 0.1, 0, 0.05], [0, 0.3, 0.2, 0.1]])
    classes = np.array([[5, 1, 0, 0, 2, 1, 0, 0], [1, 1, 1, 1, 1, 1, 1, 1]]) / np.array([[9], [8]])
    refs = divergence.References(["a", "b"], classes, common)
    words = np.array([10, 40, 0])
    doc, slot, n = np.array([0, 0, 1, 1, 1]), np.array([0, 2, 0, 1, 3]), np.array([4, 1, 8, 2, 30])
    own = np.array([[r.randrange(9) for _ in range(8)] for _ in range(3)])
    by_class, by_word, bins = divergence.distances(words, own, doc, slot, n, refs)
    for d in range(2):
        for k in range(2):
            p = {int(s): c / words[d] for x, s, c in zip(doc, slot, n) if x == d and common[k, s] > 0}
            q = {s: v for s, v in enumerate(common[k]) if v > 0}
            assert by_word[d, k] == pytest.approx(jensen_shannon(p | {"rest": 1 - sum(p.values())}, q | {"rest": 1 - sum(q.values())}))
            assert by_class[d, k] == pytest.approx(jensen_shannon(dict(enumerate(own[d] / own[d].sum())), dict(enumerate(classes[k]))))
    assert list(bins) == [4, 4]


def test_summary_keeps_all_common_words(spark):
    """Words of one in 500 are found whatever the batches, beside a long tail of others."""
    r = random.Random(5)
    texts = [" ".join(r.choices(["of", "and", "the"], (1, 5, 9), k=20) + [f"w{r.randrange(10**6)}" for _ in range(600)]) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(11)
    languages, words = divergence.common_words(df)
    assert languages == ["en"] and {b"of", b"and", b"the"} <= set(words) and len(words) <= divergence.KEEP
