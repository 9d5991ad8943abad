"""The training-data operators as Spark jobs: brute force on small tables, and odd rows everywhere."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from msgloom.llm import ann_graph, decontaminate, hilbert_pack, langid_ppm, probminhash, queries, rans_ids, suffix_dedup, url_filter, warc_fixity
from msgloom.llm.pieces import encoder_for
from msgloom.llm.queries import tokenizer_path
from msgloom.llm.token_counts import token_counts
from tests.conftest import SF
from tests.llm.test_units import brute_repeats
from tests.oracle import same

BPE, SP = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, spans string, kept boolean"
LONG = " ".join(f"word{i % 977} thing{i % 31}" for i in range(9000))
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    r = random.Random(4)
    texts = [None, "", " ", "!!", LONG, LONG, "one", "one two three", "é\u0000 x", "日本語のテキスト"] + [" ".join(r.choices(WORDS, k=90)) for _ in range(12)]
    rows = [(i, t, ("en", "fr", None)[i % 3], "s" if i % 4 else None, len(t) if t else None, 0.5, "k", "s", True) for i, t in enumerate(texts)]
    near = rows[12][1].split()
    near[40] = "changed"
    return rows + [rows[11], rows[11], (None, rows[13][1], "en", "s", 1, None, None, None, None), (50, " ".join(near), "en", "s", 3, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    got, want = same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])
    assert got == want


def test_token_counts(spark, odd, none):
    encoder = encoder_for(SP)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(odd, SP).collect())
    want = sorted((k is None, k or 0, len(t.encode()), len(x), len(x) > 4096) for (k, t), x in zip(docs_of(odd), encoder.encode([t for _, t in docs_of(odd)])))
    assert got == want and any(x[-1] for x in got) and token_counts(none, SP).count() == 0


def encoded(df):
    return [(k, [*x, 0]) for (k, t), x in zip(docs_of(df), encoder_for(BPE).encode([t for _, t in docs_of(df)]))]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_rans_files(spark, odd, none):
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rans_ids.read_ids(*rans_ids.write_ids(odd, BPE, block_ids=3000)).collect()))
    assert sorted((k is None, k or 0, n, c) for _, k, n, c in got) == sorted((k is None, k or 0, len(x), crc(x)) for k, x in encoded(odd))
    at = 0
    keys = [k for _, k, _, _ in got]
    assert [k for k in keys if k is not None] == sorted(k for k in keys if k is not None)
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert rans_ids.read_ids(*rans_ids.write_ids(none, BPE)).count() == 0


def test_packing(spark, odd, none):
    rows = hilbert_pack.pack(odd, BPE, width=256).collect()
    own = defaultdict(list)
    for r in rows:
        own[(r["sequence_id"])].append((r["offset"], r["length"]))
    full = sorted(own)
    for s in full:
        at = 0
        for offset, n in sorted(own[s]):
            assert offset == at
            at += n
        assert at == 256 or s == full[-1]
    expected = defaultdict(list)
    for k, x in encoded(odd):
        expected[(k, len(x))].append(x)
    pieces = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    for none_, k, n, start, length, c in pieces:
        assert any(crc(x[start : start + length]) == c for x in expected[(None if none_ else k, n)])
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in encoded(odd)) and hilbert_pack.pack(none, BPE).count() == 0


def test_language_id(spark, odd, none):
    held = {r["doc_id"]: r for r in queries.op7_langid_ppm(spark, "/root/testdata/sf0.01").collect()}
    truth = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    out = [held[r["doc_id"]]["lang_pred"] == r["lang"] for r in truth if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(out) / len(out) > 0.98
    assert all(held[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in truth)
    got = langid_ppm.identify(odd).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got} <= {"en", "fr", "und"} and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == "und" for r in got) == 4  # null, empty, blank, punctuation
    assert langid_ppm.identify(none).count() == 0 and langid_ppm.recognised(odd).columns == odd.columns and langid_ppm.recognised(none).count() == 0


def shingle_sets(texts):
    import re

    out = []
    for t in texts:
        w = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (t or "").lower())
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_classes(texts, threshold=0.8):
    sets, parent = shingle_sets(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same_text = texts[i] and texts[i] == texts[j]
            near = sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])
            if same_text or near:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def partition_of(labels):
    groups = defaultdict(list)
    for i, x in enumerate(labels):
        groups[x].append(i)
    return sorted(map(tuple, groups.values()))


@pytest.mark.parametrize("blocks", [(256, 1024), (7, 20)])
def test_near_duplicates_in_a_wide_family(spark, monkeypatch, blocks):
    """Copies of one text with few to many changes: chains of links, far members, and several mixed buckets."""
    monkeypatch.setattr(probminhash, "OUT_BLOCK", blocks[0])
    monkeypatch.setattr(probminhash, "IN_BLOCK", blocks[1])
    r, base, texts = random.Random(9), random.Random(1).choices(WORDS, k=140), []
    for _ in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(r.choices(WORDS, k=60)) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in probminhash.near_duplicates(df).collect()}
    assert partition_of([got[i]["class_id"] for i in range(len(texts))]) == partition_of(brute_classes(texts))
    assert sum(r["kept"] for r in got.values()) == len(set(brute_classes(texts))) and all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = probminhash.near_duplicates(odd).collect()
    texts = [t for _, t in docs_of(odd)]
    assert len(got) == len(texts) and sum(r["kept"] for r in got) == len(set(brute_classes(texts)))
    one = probminhash.one_of_each(odd)
    assert one.columns == odd.columns and one.count() == len(set(brute_classes(texts)))
    assert probminhash.near_duplicates(none).count() == 0


def probability_jaccard(a, b):
    """By its definition, over counted shingles."""
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in {*a, *b}) for x in {*a} & {*b})


def test_near_duplicates_that_repeat_lines(spark):
    """Texts that say a line many times are linked by weights or by plain similarity, as brute force over all pairs finds."""
    r, texts = random.Random(21), []
    for _ in range(20):
        w = r.choices(WORDS, k=300)
        line = w[100:114]
        texts += [" ".join(w), " ".join(w[:114] + line * 60 + w[114:])]
    for _ in range(6):  # alike in weights alone: the repeated line outweighs what differs
        line = r.choices(WORDS, k=12)
        texts += [" ".join(line * 40 + r.choices(WORDS, k=20)) for _ in range(3)]
    sets = []
    for t in texts:
        w = t.split()
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    edges = set()
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            common = len({*a} & {*b})
            if common and max(common / len({*a, *b}), probability_jaccard(a, b)) >= 0.8:
                edges.add((j, i))
    assert {(2 * k, 2 * k + 1) for k in range(20)} <= edges and len(edges) > 20
    labels = list(range(len(texts)))
    for j, i in sorted(edges):
        old, new = max(labels[i], labels[j]), min(labels[i], labels[j])
        labels = [new if x == old else x for x in labels]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in probminhash.near_duplicates(df).collect()}
    assert partition_of([got[i] for i in range(len(texts))]) == partition_of(labels)


def test_near_duplicates_of_the_test_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs_of(df)
    got = {x["doc_id"]: x["class_id"] for x in probminhash.near_duplicates(df).collect()}
    assert partition_of([got[i] for i, _ in rows]) == partition_of(brute_classes([t for _, t in rows]))


NAMES = ["__row", "__id", "__key", "__text", "__whole", "__spans", "__gone", "__leak", "__near_id", "whole", "file", "at", "row", "id", "key", "begin", "words", "digest", "bands", "node", "comp", "a b", "c.d"]


@pytest.mark.parametrize("written", [False, True])
def test_stages_keep_columns_of_any_name(spark, odd, written, tmp_path):
    import corpus_pipeline

    df = odd.select("*", *(F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES if n not in odd.columns))
    if written:
        df.repartition(3).write.parquet(f"{tmp_path}/odd")
        df = spark.read.parquet(f"{tmp_path}/odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        rows = out.collect()
        assert rows
        for x in rows:
            d = x.asDict()
            assert all(d[n] == f"{n} of {'none' if x['doc_id'] is None else x['doc_id']}" for n in NAMES if n not in odd.columns)


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats(spark, odd, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(11)
    line = lambda k: " ".join(r.choices(WORDS, k=k))
    passage, texts = line(30), [t for _, t in docs_of(odd)]
    texts += [passage + line(k) for k in range(0, 40, 4)] + [line(20) + passage] + [line(9) + passage + line(3) for _ in range(8)] + ["a" * 300, "xy" * 200, line(12) * 4, "é" * 90]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for m in (60, 101):
        got = {x["doc_id"]: x for x in suffix_dedup.repeat_report(df, min_bytes=m).collect()}
        want = brute_repeats([t.encode() for t in texts], m)
        assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == want
    assert suffix_dedup.repeat_report(none).count() == 0
    cut = suffix_dedup.without_repeats(odd, min_bytes=60)
    assert cut.columns == odd.columns and cut.count() == odd.count() and suffix_dedup.repeat_report(odd).count() == odd.count()


def test_repeats_of_the_test_table(spark, monkeypatch):
    """Every document of sf0.01, in bytes and in words; without the shards' suffix arrays nothing is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = {r["doc_id"]: r for r in queries.op3_suffix_array_repeats(spark, "/root/testdata/sf0.01").collect()}
    want = dict(zip([k for k, _ in rows], brute_repeats([t.encode() for _, t in rows], 400)))
    assert all((g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == want[k] for k, g in got.items()) and len(got) == len(rows)
    left = brute_word_repeats([t for _, t in rows], 51)
    assert all(got[k]["passage_bytes"] == len(t.encode()) - len(x.encode()) and (got[k]["n_passages"] > 0) == (t != x) for (k, t), x in zip(rows, left))
    assert sum(g["n_removed"] > 0 for g in got.values()) > 10 and sum(g["n_passages"] > 0 for g in got.values()) > 10
    none = lambda *a: tuple(np.zeros(0, np.int64) for _ in range(3))
    monkeypatch.setattr(suffix_dedup, "_shard", lambda what: _shard_without(none))
    assert suffix_dedup.repeat_report(docs.limit(300)).agg(F.sum("n_removed"), F.sum("n_passages")).first() == (0, 0)


def _shard_without(found):
    def shard(rows):
        import pyarrow as pa

        return pa.table({x: pa.array([], pa.int64()) for x in ("id", "key", "g", "s", "n", "first", "a", "b")})

    return shard


def brute_word_repeats(texts, m):
    """Texts without the bytes of any run of ``m`` words between white space that occurs twice."""
    runs = []
    for t in texts:
        w = [x.span() for x in re.finditer(r"\S+", t)]
        runs.append([(w[k][0], w[k + m - 1][1]) for k in range(len(w) - m + 1)])
    seen = Counter(t[a:b] for t, own in zip(texts, runs) for a, b in own)
    out = []
    for t, own in zip(texts, runs):
        gone = {k for a, b in own if seen[t[a:b]] > 1 for k in range(a, b)}
        out.append("".join(c for k, c in enumerate(t) if k not in gone))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats_of_words(spark, odd, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(12)
    line = lambda k, longest=9: " ".join("".join(r.choices("abcdeé", k=r.randint(1, longest))) for _ in range(k))
    short, middle, almost = line(51, 1), line(70), line(50)
    texts = [f"{line(r.randint(0, 60))} {x} {line(r.randint(0, 60))}" for x in (short, middle, almost) for _ in range(8)]
    texts += [short, middle + "x", "x" + middle, middle.replace(" ", "\u00a0"), middle[:200], " ".join(middle.split()[:51]), almost, short + "\n" + short, "", "\t\n", line(50, 1) + " b", "a " * 400, "word " * 51]
    texts += [line(3) + " " + " ".join(middle.split()[k : k + 52]) + " " + line(3) for k in range(0, 18)]
    texts += [t or "" for _, t in docs_of(odd)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for m in (51, 12):
        got = {x["doc_id"]: x["text"] for x in suffix_dedup.without_repeats(df, min_words=m).collect()}
        assert [got[i] for i in range(len(texts))] == brute_word_repeats(texts, m)
    han = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(60))
    got = suffix_dedup.without_repeats(spark.createDataFrame([(1, "一" + han), (2, "二" + han), (3, han[:50])], "doc_id long, text string"), min_words=51).collect()
    assert {x["doc_id"]: x["text"] for x in got} == {1: "一", 2: "二", 3: han[:50]}


def test_pipeline_cuts_short_words(spark):
    import corpus_pipeline

    passage = " ".join("abcdefgh"[k * k % 7 % 5] + "xyz"[k % 3] * (k % 2) for k in range(51))
    long_words = " ".join(f"longer{k:02d}word{k:02d}" for k in range(50))
    texts = [f"one here {passage} and there", f"two before {passage} then", f"three {long_words} four", f"five {long_words} six"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in corpus_pipeline.repeat_removal(spark, df, SF).collect()}
    want = ["one here  and there", "two before  then", *texts[2:]]
    assert len(passage) < 256 and got == {i: (t, len(t)) for i, t in enumerate(want)}


def test_decontamination(spark, odd, none):
    r = random.Random(3)
    items = [r.choices(WORDS, k=k) for k in (40, 25, 14, 9, 6, 4)]  # the last in a document, too: short items are looked for whole
    changed = list(items[0])
    for k in (5, 13, 22, 31, 38):
        changed[k] = "other"
    far = [w if k % 2 else "other" for k, w in enumerate(items[1])]
    texts = {100: items[0], 101: changed, 102: r.choices(WORDS, k=30) + items[1] + r.choices(WORDS, k=30), 103: far, 104: items[2], 105: ["zz", *items[3], "yy"], 106: items[4], 107: items[5], 108: items[3][:-1]}
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (0, " ".join(items[0]))], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.overlaps(docs, bench).collect()}
    assert set(got) == {(100, 0), (101, 0), (102, 1), (104, 2), (105, 3), (106, 4), (107, 5)}
    assert got[(101, 0)]["n_same"] >= 33 and got[(102, 1)]["start"] == 30 and got[(102, 1)]["n_words"] == 25
    left = {x["doc_id"] for x in decontaminate.decontaminate(docs, bench).collect()}
    assert left == {k for k, _ in docs_of(docs)} - {100, 101, 102, 104, 105, 106, 107}
    assert decontaminate.overlaps(none, bench).count() == 0 and decontaminate.overlaps(docs, bench.filter("false")).count() == 0


def brute_overlaps(docs, items):
    """Pairs of ids with an overlap on any diagonal."""
    vocabulary: dict = {}
    code = lambda t: np.asarray([vocabulary.setdefault(w, len(vocabulary)) for w in re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (t or "").lower())], np.int64)
    own = [(k, code(t)) for k, t in items]
    places, out = defaultdict(list), set()
    for n, (_, words) in enumerate(own):
        for p, w in enumerate(words.tolist()):
            places[w].append((n, p))
    for d, t in docs:
        words, hits = code(t), Counter()
        for q, w in enumerate(words.tolist()):
            hits.update((n, q - p) for n, p in places.get(w, ()))
        for (n, diagonal), c in hits.items():
            k, item = own[n]
            if len(item) < 12:
                out |= {(d, k)} if c == len(item) else set()
                continue
            lo, hi = max(0, -diagonal), min(len(item), len(words) - diagonal)
            at = np.flatnonzero(item[lo:hi] == words[lo + diagonal : hi + diagonal])
            if len(at) >= 9 and any(at[j] - at[i] >= 11 and j - i + 1 >= 0.75 * (at[j] - at[i] + 1) for i in range(len(at)) for j in range(len(at) - 1, i, -1)):
                out.add((d, k))
    return out


def test_no_overlap_is_lost(spark):
    r = random.Random(5)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 3, 4, 5, 7, 9, 11, 12, 13, 20, 30, 60])))) for i in range(50)]
    docs = []
    for d in range(250):
        w = r.choice(items)[1].split()
        a = r.randrange(len(w))
        rate = r.choice([0, 0.1, 0.2, 0.25, 0.3])
        part = [r.choice(words) + "q" if r.random() < rate else y for y in w[a : r.randrange(a, len(w)) + 1]]
        docs.append((d, " ".join(r.choices(words, k=r.randint(0, 30)) + part + r.choices(words, k=r.randint(0, 30)))))
    head, tail = [f"z{i}" for i in range(12)], [f"y{i}" for i in range(140)]
    items.append((77, " ".join(head + tail)))
    docs.append((900, " ".join(head + ["no" if k % 7 < 2 else w for k, w in enumerate(tail)])))  # a good run before a mediocre one
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.overlaps(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_overlaps(docs, items) and (900, 77) in got
    table = lambda name, key: [(x[key], x["text"]) for x in spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").select(key, "text").collect()]
    got = {(x["doc_id"], x["item_id"]) for x in queries.op5_spaced_seed_overlaps(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute_overlaps(table("documents", "doc_id"), table("benchmark", "item_id")) and got


def test_a_large_benchmark_leaves_unrelated_texts_alone(spark):
    """The bitmap grows with the benchmark: next to no region of texts that share nothing with 4,000 items."""
    items = spark.range(4000).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(80)), lambda k: F.hex(F.xxhash64("id", k)))).alias("text"))
    texts = spark.range(200).select("id", F.col("id").alias("key"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.hex(F.xxhash64("id", k, F.lit(5))))).alias("text"))
    with decontaminate.passing():
        _, marks = decontaminate._items(items, "item_id")
        bitmap, bits = decontaminate._bitmap(marks)
        assert 2**bits >= 32 * marks.count()
        regions = decontaminate._regions(texts, spark.sparkContext.broadcast(bitmap), bits, []).select(F.sum(F.size("hits"))).first()[0] or 0
    assert regions < 200 * 500 / 500


def test_overlaps_tell_rows_of_one_id_apart(spark):
    bench = spark.createDataFrame([(1, " ".join(WORDS[:20]))], "item_id long, text string")
    docs = spark.createDataFrame([(None, " ".join(WORDS[:20]), "a"), (None, " ".join(WORDS[30:50]), "b"), (7, " ".join(WORDS[5:20]), "c"), (7, "clean", "d"), (7, "clean", "d")], "doc_id long, text string, key string")
    assert sorted(x["key"] for x in decontaminate.decontaminate(docs, bench).collect()) == ["b", "d", "d"]
    assert sorted((x["doc_id"] or 0, x["n_words"]) for x in decontaminate.overlaps(docs, bench).collect()) == [(0, 20), (7, 15)]


@pytest.mark.parametrize("sigma", [0.0, 0.25, 1.0])
def test_recall_of_inner_products(spark, sigma):
    """Norms that differ, in full shards: the nearest by inner product, against brute force."""
    r = np.random.default_rng(11)
    x = r.standard_normal((6000, 48))
    x = x / np.linalg.norm(x, axis=1)[:, None] * np.exp(sigma * r.standard_normal(6000))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = ann_graph.usable(df)
    got = defaultdict(set)
    for n in ann_graph.nearest(v, v.filter("vec_id % 60 = 0")).collect():
        got[n["query_id"]].add(n["vec_id"])
    hits = 0
    for q in range(0, 6000, 60):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * 100) > 0.95


def test_recall_of_long_vectors(spark):
    """384 independent components: the beam widens itself. Queries are rows, and rows that the graphs don't hold."""
    r = np.random.default_rng(8)
    x = r.normal(size=(3100, 384))
    rows = ann_graph.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    for asked, held in ((range(0, 3000, 60), 3000), (range(3000, 3100), 3000)):
        got = defaultdict(list)
        for row in ann_graph.nearest(rows.filter(F.col("vec_id") < held), rows.filter(F.col("vec_id").isin(*asked))).collect():
            got[row["query_id"]].append(row["vec_id"])
        score = x[list(asked)] @ x[:held].T
        hits = 0
        for k, q in enumerate(asked):
            if q < held:
                score[k, q] = -np.inf
            hits += len(set(np.argsort(-score[k])[:20].tolist()) & set(got[q]))
        assert hits >= 0.95 * 20 * len(asked)


def test_recall_of_the_test_table(spark):
    x = {r["vec_id"]: np.asarray(r["embedding"], float) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect() if r["embedding"] is not None}
    ids = np.asarray(sorted(k for k, v in x.items() if np.isfinite(v).all() and (v != 0).any()))
    all_ = np.stack([x[k] for k in ids])
    got = defaultdict(set)
    for n in queries.op2_ann_graph_search(spark, "/root/testdata/sf0.01").collect():
        got[n["query_id"]].add(n["vec_id"])
    asked, hits = [k for k in ids if k % 20 == 0], 0
    for q in asked:
        order = [k for k in ids[np.lexsort((ids, -(all_ @ x[q])))].tolist() if k != q][:20]
        hits += len(got[q] & set(order))
    assert hits / (20 * len(asked)) > 0.95 and set(got) == set(asked)


def test_neighbours_of_any_size(spark):
    """Components from 1e-150 to 1e150 take part; scores are those of the original vectors."""
    r = np.random.default_rng(2)
    x = r.standard_normal((60, 6)) * 10.0 ** r.choice([-150, -20, 0, 20, 150], 60)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = ann_graph.usable(df)
    got = defaultdict(list)
    for n in ann_graph.nearest(v, v.filter("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[n["query_id"]].append((n["vec_id"], n["score"]))
    for q in (0, 20, 40):
        with np.errstate(all="ignore"):
            want = sorted((-float(x[q] @ x[i]), i) for i in range(60) if i != q)[:10]
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in want], rel=1e-9)


def test_neighbours(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((700, 12)).round(2)
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)] + [(700 + i, [float(v) for v in x[20]]) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0, None]), (2080, []), (2100, [1.0, 2.0]), (2101, [2.0, 1.0]), (None, [1.0] * 12), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    v = ann_graph.usable(df)
    got = defaultdict(list)
    for n in ann_graph.nearest(v, v.filter("vec_id % 20 = 0"), k=20, shard_rows=200).orderBy("query_id", "rank").collect():
        got[n["query_id"]].append((n["vec_id"], n["score"]))
    vectors = {i: np.asarray(e) for i, e in rows[:760]}
    hits = total = 0
    for q in [i for i in vectors if i % 20 == 0]:
        want = sorted(((-float(vectors[q] @ e), i) for i, e in vectors.items() if i != q))[:20]
        assert len(got[q]) == 20 and all(abs(s - float(vectors[q] @ vectors[i])) < 1e-9 for i, s in got[q]) and [(-s, i) for i, s in got[q]] == sorted((-s, i) for i, s in got[q])
        hits += len({i for _, i in want} & {i for i, _ in got[q]})
        total += 20
    assert hits / total > 0.95 and [i for i, _ in got[2100]] == [2101] and not {2000, 2020, 2040, 2060, 2080} & set(got)
    assert ann_graph.nearest(v.filter("false"), v.filter("false")).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.b.net/fr/?q", "http://net/es/", "http://x.org/a", "http://example.com", "http://example.com#/en/", "ftp://notexample.com/en/", "http://sub.www.example.com/en/a://b"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(3, urls[3], None)], "page_id long, url string, rule string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.query_rules(spark)).collect())
    want = [("", "", "", "allow"), ("", "", "", "allow"), ("", "", "", "allow"), ("example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("a.b.net", "/fr/", "net/fr/", "block"), ("net", "/es/", "net/es/", "block"), ("x.org", "/a", "", "allow"), ("example.com", "", "", "allow"), ("example.com", "", "", "allow"), ("notexample.com", "/en/", "com/", "allow"), ("sub.www.example.com", "/en/a://b", "www.example.com/en/", "allow")]
    assert got == sorted([(i, *w) for i, w in enumerate(want)] + [(3, *want[3])])
    assert url_filter.filter_urls(pages, url_filter.query_rules(spark).filter("false")).filter("verdict = 'allow' and rule is null").count() == len(urls) + 1
    assert url_filter.filter_urls(pages.filter("false"), url_filter.query_rules(spark)).count() == 0


def test_fixity(spark):
    rows = [(i, f"http://x/{i}", "h" * (i % 90)) for i in range(300)] + [(5, "http://x/5", "again"), (None, None, None), (9000, "http://y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    assert warc_fixity.audit(pages, pages.repartition(3)).count() == 0
    other = pages.filter("page_id is null or page_id <> 7").withColumn("html", F.when(F.col("page_id") == 9, "bad").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(400, "u", "h", "d")], "page_id long, url string, html string, digest string"))
    got = {(r["page_id"], r["kind"]) for r in warc_fixity.audit(pages, other).collect()}
    assert got == {(7, "missing"), (9, "changed"), (400, "extra")}
    assert warc_fixity.audit(pages.filter("false"), pages.filter("false")).count() == 0
    assert {(r["page_id"], r["kind"]) for r in warc_fixity.audit(pages.filter("page_id < 3"), pages.filter("false")).collect()} == {(0, "missing"), (1, "missing"), (2, "missing")}


def test_fixity_descends_only_where_digests_differ(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", "h" * (i % 90)) for i in range(0, 200_000, 9)] + [(None, "u", "null id"), (-1, "u", "minus one"), (77, "long", "é" * 300_000), (77, "long", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read, within = [], warc_fixity._within
    monkeypatch.setattr(warc_fixity, "_within", lambda level, suspects, *keys: read.append((tuple(keys), within(level, suspects, *keys).count())) or within(level, suspects, *keys))
    assert warc_fixity.audit(pages, pages.repartition(5)).count() == 0 and not read  # equal roots end it
    other = pages.withColumn("html", F.when(F.col("page_id").isin(9, 90_000), "bad").when(F.col("page_id").isNull(), "changed").otherwise(F.col("html")))
    got = {(r["page_id"], r["warc_file"], r["kind"]) for r in warc_fixity.audit(pages, other).collect()}
    assert got == {(9, 0, "changed"), (90_000, 21, "changed"), (None, -1, "changed")}
    records = [n for keys, n in read if keys == ("warc_file", "range")]
    assert len(records) == 2 and max(records) <= 3 * 64 // 9 + 4


def test_pipeline_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, docs, SF)
            assert name == "packing" or docs.columns == before.columns
            docs = corpus_pipeline.materialize(docs, "test")
        assert (docs.count() > 0) == (before.count() > 0)
    assert corpus_pipeline.run(spark, SF).count() > 0
