"""Operators on small tables: metrics, determinism under repartitioning, policy, streams against batch, sources."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from msgloom.operators import audit, augment, evaluate, quality, sampling, scoring, traffic
from msgloom.plans import traffic_queries, views
from msgloom.sources import readers, writers
from msgloom.streaming import streams
from tests.conftest import SF


def test_metrics_from_known_confusion(spark):
    cells = {("ham", "ham"): 8, ("ham", "spam"): 2, ("spam", "spam"): 3, ("spam", "phishing"): 1, ("phishing", "ham"): 1, ("phishing", "phishing"): 5}
    rows = [(g, p) for (g, p), n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "gold string, pred string")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in evaluate.per_class(df).collect()}
    assert got["ham"] == (0.8889, 0.8, 0.8421, 10) and got["spam"] == (0.6, 0.75, 0.6667, 4) and got["phishing"] == (0.8333, 0.8333, 0.8333, 6)
    assert tuple(evaluate.accuracies(df).first()) == (20, 0.8, 0.85)


@pytest.mark.parametrize("name", ["undersample", "stratified_sample", "random_split", "balanced_resample", "take_sample"])
def test_sampling_does_not_depend_on_partitions(spark, name):
    x = views.labelled(spark, SF)
    f = {"undersample": lambda d: sampling.undersample(d), "stratified_sample": lambda d: sampling.stratified_sample(d, 30), "random_split": lambda d: sampling.random_split(d), "balanced_resample": lambda d: sampling.balanced_resample(d), "take_sample": lambda d: sampling.take_sample(d, 20)}[name]
    rows = [sorted(map(str, f(x.repartition(n)).collect())) for n in (1, 4, 16)]
    assert rows[0] == rows[1] == rows[2] and rows[0]


@pytest.mark.parametrize("rare", [30, 4])  # means of 33 and 250
def test_rare_labels_get_their_whole_share(spark, rare):
    label = F.when(F.col("row_id") < rare, "rare").when(F.col("row_id") % 2 == 0, "even").otherwise("odd")
    rows = sampling.balanced_resample(spark.range(3000).withColumnRenamed("id", "row_id").withColumn("label", label)).groupBy("label", "row_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("most")).collect()
    assert all(r["n"] == r["d"] == r["most"] for r in rows)
    drawn = {x: sum(r["n"] for r in rows if r["label"] == x) for x in ("rare", "even", "odd")}
    assert all(abs(n - 1000) < 4 * 1000**0.5 for n in drawn.values()), drawn
    assert len({r["n"] for r in rows if r["label"] == "rare"}) > 1


def test_poisson_ladder_reaches_every_number(spark):
    means = [1e-9, 0.3, 1.0, 2.95, 12.0, 33.3, 64.0]
    for m, rungs in spark.createDataFrame([(m,) for m in means], "m double").select("m", sampling._rungs(F.col("m"))).collect():
        assert rungs[-1] > 1 - 2**-32 and all(a <= b for a, b in zip(rungs, rungs[1:]))  # the largest number is below it
        assert sum(1 - x for x in rungs) == pytest.approx(m, abs=1e-9)


def test_augment_does_not_depend_on_partitions(spark):
    x = views.labelled(spark, SF)
    rows = [sorted(map(str, augment.augment(x.repartition(n)).collect())) for n in (1, 5)]
    assert rows[0] == rows[1]


def test_keep_first_and_labels(spark):
    df = spark.createDataFrame([(2, "same text here", "spam"), (1, "same text here", "ham"), (3, "your otp is 12", "phishing"), (4, "word", "ham")], "row_id long, text string, label string")
    got = {(r["row_id"], r["label"]) for r in quality.clean_dataset(df).collect()}
    assert got == {(1, "ham"), (3, "ham")}


def test_median_is_the_upper_middle(spark):
    df = spark.createDataFrame([("a" * n,) for n in (1, 2, 4, 8)], "text string")
    assert quality.length_stats(df).first()["median"] == 4


def test_empty_tables(spark):
    none = views.labelled(spark, SF).filter("false")
    assert quality.clean_dataset(none).count() == 0 and sampling.undersample(none).count() == 0
    assert quality.label_distribution(none).count() == 0 and quality.text_quality(none).count() == 1


def test_policy_reasons(spark):
    df = spark.createDataFrame([("", None, None, "spam", 0.9), ("x", "coding", None, "spam", 0.9), ("x", None, "boom", "spam", 0.9), ("x", None, None, "spam", 0.5), ("x", None, None, "spam", 0.9), ("x", None, None, "phishing", 0.9)], "text string, unclassifiable string, error string, label string, conf double")
    rules = spark.createDataFrame([("spam", "drop")], "label string, action string")
    got = sorted((r["reason"], r["action"], r["effective_label"]) for r in scoring.apply_policy(df, rules).fillna("-").collect())
    assert got == [("below_threshold", "forward", "ham"), ("empty", "forward", "-"), ("error", "forward", "-"), ("no_rule", "forward", "phishing"), ("rule", "drop", "spam"), ("skipped", "forward", "-")]


def test_classifier_learns(spark):
    rows = [(i, ("win cash prize now" if i % 3 == 0 else "verify your bank login" if i % 3 == 1 else "see you at lunch") + f" {i}", ("spam", "phishing", "ham")[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, text string, label string")
    model = scoring.train_classifier(df.filter("row_id < 60"), df.filter("row_id >= 60"), penalties=(0.01,))
    scored = scoring.classify(model, df.filter("row_id >= 60"))
    assert scored.filter("label = pred").count() == 30


def test_micro_batches(spark):
    at = [0, 10, 20, 60, 61, 200]
    df = spark.createDataFrame([(0, i, f"2024-01-01 00:00:00.{t:03d}") for i, t in enumerate(at)], "instance int, message_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["batch"] for r in traffic.micro_batch_assign(df, 64, 50.0).orderBy("message_id").collect()] == [0, 0, 0, 1, 1, 2]
    assert [r["batch"] for r in traffic.micro_batch_assign(df, 2, 50.0).orderBy("message_id").collect()] == [0, 0, 1, 1, 2, 3]


def test_rolling_rate_window(spark):
    df = spark.createDataFrame([("a", f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}", 5) for s in (0, 65)], "instance string, ts string, size long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["rate"] for r in traffic.rolling_rate(df).orderBy("ts").collect()] == [0.0, 0.0833]


# -- streams against batch -----------------------------------------------------------------------------------------------


def collected(spark, stream, tmp_path, mode):
    out = str(tmp_path / "out")
    streams.run_available(stream, lambda b, n: b.write.mode("append" if mode == "append" else "overwrite").parquet(out), str(tmp_path / "cp"), mode)
    return spark.read.parquet(out)


def as_stream(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_minute_counters_stream(spark, tmp_path):
    x = traffic_queries.actions(spark, SF)
    late = x.agg(F.max("ts")).first()[0]
    got = collected(spark, streams.minute_counters(as_stream(spark, x, tmp_path, "in")), tmp_path, "append")
    want = {tuple(r) for r in traffic.stats_per_minute(x).collect()}
    got = {tuple(r) for r in got.collect()}
    assert got <= want and all((late - r[0]).total_seconds() < 600 for r in want - got)  # the last minutes stay open


def test_audit_stats_stream(spark, tmp_path):
    x = traffic_queries.actions(spark, SF)
    got = collected(spark, streams.audit_stats(as_stream(spark, x, tmp_path, "in"), "1 day"), tmp_path, "complete")
    pick = ["start", "label", "model", "n"]
    assert {tuple(r) for r in got.select(*pick).collect()} == {tuple(r) for r in streams.audit_stats(x, "1 day").select(*pick).collect()}


def test_classify_stream_writes_by_action(spark, tmp_path):
    x = views.labelled(spark, SF).select("row_id", "text", F.lit(None).cast("string").alias("unclassifiable"), F.lit(None).cast("string").alias("error"))
    rules = spark.createDataFrame([("spam", "drop"), ("phishing", "reject")], "label string, action string")
    stream = streams.classify_stream(as_stream(spark, x, tmp_path, "in"), rules, 0.4)
    streams.write_by_action(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == x.count()


# -- sources and sinks ---------------------------------------------------------------------------------------------------


def test_csv_dialects_differ(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'text,label\nhi, you,ham\n"win, now",spam\n"all quoted","spam"\nbad \xff byte,ham\n')
    hand = [(r["text"], r["label"]) for r in readers.read_labelled(spark, str(path)).collect()]
    assert hand == [("hi, you", "ham"), ('"win, now"', "spam"), ("bad  byte", "ham")]
    rows = [(r["text"], r["label"]) for r in readers.read_labelled(spark, str(path), "csv").collect()]
    assert ("win, now", "spam") in rows and ("all quoted", "spam") in rows


def test_imc25_counts_what_it_skips(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text("text,scam_type,language\na,spam,en\nb,bank,\n,spam,en\nc,,en\n")
    got = [(r["text"], r["gold"], r["language"]) for r in readers.read_imc25(spark, str(path)).collect()]
    assert got == [("a", "spam", "en"), ("b", "phishing", "unknown")] and readers.skipped(spark, str(path)).first()[0] == 1


def test_uci_keeps_later_tabs(spark, tmp_path):
    path = tmp_path / "u.tsv"
    path.write_text("label\ttext\n\nham\ta\tb\nspam\twin\n")
    assert [(r["text"], r["gold"]) for r in readers.read_uci_tsv(spark, str(path)).collect()] == [("a\tb", "ham"), ("win", "spam")]


def test_audit_lines_that_are_no_json(spark, tmp_path):
    (tmp_path / "audit_1.jsonl").write_text('{"timestamp":"2026-03-03T23:54:04+00:00Z","entry_type":"prediction","label":"ham"}\nnot json\n')
    a = readers.read_audit(spark, str(tmp_path / "audit_*.jsonl")).cache()
    assert readers.malformed(a).first()[0] == 1 and a.filter("label = 'ham'").count() == 1


def test_latin1_fallback(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café\n".encode())
    (tmp_path / "b.txt").write_bytes("café\n".encode("latin-1"))
    assert {r["line"] for r in readers.read_with_fallback(spark, str(tmp_path / "*.txt")).collect()} == {"café"}


def test_dataset_round_trip(spark, tmp_path):
    x = spark.createDataFrame([('a "quoted", text', "ham"), ("line\nbreak", "spam")], "text string, label string")
    writers.write_dataset(x, str(tmp_path / "d"), "csv")
    back = readers.read_labelled(spark, str(tmp_path / "d"), "csv")
    assert {(r["text"], r["label"]) for r in back.collect()} == {('a "quoted", text', "ham"), ("line\nbreak", "spam")}


# -- exact duplicates and leaks by digests and word numbers ----------------------------------------------------------------


def test_first_of_equal_texts(spark):
    """Ties of the order, null orders and null texts, hot texts; the same at any partitioning."""
    rows = [(i, f"text {i % 7}" if i % 11 else None, "x") for i in range(200)] + [(None, "text 1", "late"), (None, "alone", "y"), (3, "text 3", "x"), (5, "hot", "a"), (5, "hot", "a")]
    df = spark.createDataFrame(rows, "row_id long, text string, label string")
    for n in (1, 5):
        got = quality.dedup_keep_first(df.repartition(n), ["text"]).collect()
        first = {}
        for i, text, _ in rows:
            first[text] = min((x for x in (first.get(text), i) if x is not None), default=None)
        assert sorted(map(str, ((r["text"], r["row_id"]) for r in got))) == sorted(map(str, first.items()))
    assert quality.dedup_keep_first(df.limit(0), ["text"]).count() == 0
    pairs = quality.dedup_keep_first(df, ["text", "label"]).count()
    assert pairs == len({r[1:] for r in rows})


def test_digests_tell_columns_apart(spark):
    df = spark.createDataFrame([("a", "b1"), ("ab", "1"), (None, "x"), ("-", "x"), ("", None), (None, "")], "a string, b string")
    assert df.select(quality.digest_of(["a", "b"]).alias("d")).distinct().count() == 6


def test_text_counts_move_no_text(spark, capsys):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    quality.text_counts(df).explain()
    assert "SortAggregate" not in capsys.readouterr().out


def brute_leaks(items, texts, threshold):
    sets = [set(re.findall(r"\w+", (t or "").lower())) for _, t in texts]
    gone = set()
    for key, text in items:
        own = set(re.findall(r"\w+", (text or "").lower()))
        if own and any(len(own & s) >= math.ceil(threshold * len(own)) for s in sets) or text is not None and any(text == t for _, t in texts):
            gone.add(key)
    return {k for k, _ in items} - gone


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_leaks_against_brute_force(spark, threshold):
    r = random.Random(8)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 90}" for _ in range(400)]
    texts = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 10, 40])))) for i in range(80)] + [(90, None), (91, ""), (92, "!!!"), (93, "All New words")]
    items = [(i, " ".join(r.choices(vocabulary + ["unseen", "other"], k=r.choice([1, 2, 4, 9, 12])))) for i in range(120)] + [(200, None), (201, ""), (202, "!!!"), (203, "all NEW words, words")]
    got = quality.decontaminate(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "row_id long, text string"), threshold)
    assert {x["item_id"] for x in got.collect()} == brute_leaks(items, texts, threshold)
    assert quality.decontaminate(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([], "row_id long, text string"), threshold).count() == len(items)


@pytest.mark.parametrize("steps", [3, 9])
def test_calibration_cells_equal_every_bias(spark, steps):
    """Ties on thresholds, equal and missing logits: the cells' counts are those of each bias applied to each row."""
    r = random.Random(4)
    pick = lambda: r.choice([0.0, 0.5, 1.0, -1.5, 2.0, r.uniform(-3, 3), 0.1, 0.30000000000000004])
    rows = [(r.choice(["ham", "spam", "phishing"]), [pick(), pick(), pick()]) for _ in range(250)]
    got = {(x["spam"], x["phishing"]): x for x in evaluate.calibration_grid(spark.createDataFrame(rows, "gold string, logits array<double>"), 2.0, steps).collect()}
    values = [-2.0 + 4.0 * k / (steps - 1) for k in range(steps)]
    assert len(got) == steps**2
    for a in values:
        for b in values:
            preds = [(g, "ham" if h >= s + a and h >= p + b else "spam" if s + a >= p + b else "phishing") for g, (h, s, p) in rows]
            assert got[a, b]["accuracy_3class"] == pytest.approx(sum(g == x for g, x in preds) / len(preds), abs=6e-5)
            assert got[a, b]["accuracy_block"] == pytest.approx(sum((g == "ham") == (x == "ham") for g, x in preds) / len(preds), abs=6e-5)


def test_sketches_unite_over_days_and_streams(spark):
    """Any range within 3 % of the exact count, from rows of days, however the entries came."""
    days = [(f"2024-01-{1 + k % 9:02d} 10:00:00", f"10.{k % 40000 // 250}.0.{k % 250}" if k % 5 else "system", "prediction") for k in range(60_000)]
    df = spark.createDataFrame(days, "timestamp string, client_ip string, entry_type string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    kept = audit.client_sketches(df.limit(20_000)).unionByName(audit.client_sketches(df.exceptAll(df.limit(20_000)))).cache()
    for first, last in (("2024-01-01", "2024-01-09"), ("2024-01-03", "2024-01-04"), ("2024-01-05", "2024-01-05")):
        exact = len({ip for t, ip, _ in days if first <= t[:10] <= last and ip != "system"})
        got = audit.clients_between(kept, first, last).first()
        assert got["n"] == sum(first <= t[:10] <= last for t, _, _ in days) and abs(got["clients"] - exact) <= 0.03 * exact
    stream = streams.audit_stats(df.selectExpr("timestamp as ts", "'ham' as label", "'m' as model", "0.5 as confidence", "client_ip"), "1 day")
    united = stream.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch"))).first()[0]
    assert abs(united - len({ip for _, ip, _ in days if ip != "system"})) <= 0.03 * 32_000


def test_guarded_scoring(spark, tmp_path):
    """Batches hold texts of like length, the scorer is loaded once a process, and only rows that fail are errors."""
    log = str(tmp_path / "log")

    def scorer():
        import os

        with open(f"{log}-loads", "a") as f:
            f.write(f"{os.getpid()}\n")

        def run(texts):
            with open(f"{log}-{os.getpid()}", "a") as f:
                f.write(" ".join(str(len(t)) for t in texts) + "\n")
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [[len(t) / 10, 0.5, 0.1] for t in texts]

        return run

    r = random.Random(6)
    rows = [(i, "bad one" if i % 13 == 0 else None if i % 31 == 1 else "x" * r.randrange(1, 200), "known" if i == 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, text string, error string").repartition(4)
    scored = scoring.score_messages(df, scorer, batch=8, guarded=True)
    got = {x["row_id"]: x for _ in range(2) for x in scored.collect()}
    assert len(got) == 200
    for i, text, error in rows:
        bad = text == "bad one"
        assert got[i]["error"] == (error or ("ValueError: no" if bad else None)) and (got[i]["logits"] is None) == bad
        assert bad or got[i]["logits"] == [len(text or "") / 10, 0.5, 0.1]
    loads = (tmp_path / "log-loads").read_text().split()
    assert len(loads) == len(set(loads))
    batches = [[int(n) for n in line.split()] for f in tmp_path.glob("log-[0-9]*") for line in f.read_text().splitlines()]
    assert max(map(len, batches)) <= 8 and all(b == sorted(b) for b in batches)
    with pytest.raises(Exception, match="no"):
        scoring.score_messages(df, scorer, batch=8).collect()


def test_lines_of_split_files(spark, tmp_path):
    """Characters across the borders of splits, in files of either charset; line numbers run on through the splits."""
    texts = {"a": ["é" * (k % 9) + f"ñ{k}" if k % 5 else "" for k in range(900)], "b": [f"ü{k}€" for k in range(700)]}
    (tmp_path / "a.txt").write_bytes("\r\n".join(texts["a"]).encode("latin-1"))
    (tmp_path / "b.txt").write_bytes("\n".join(texts["b"]).encode("utf-8"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in was:
        spark.conf.set(k, "401")
    try:
        got = readers.read_with_fallback(spark, str(tmp_path / "*.txt")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    for name, lines in texts.items():
        own = sorted((r["at"], r["line"]) for r in got if r["path"].endswith(f"{name}.txt"))
        assert own == [(k, line) for k, line in enumerate(lines) if line]


def test_audit_files_are_capped_by_bytes(spark, tmp_path):
    from datetime import date

    path, r = str(tmp_path / "log"), random.Random(2)
    rows = [(f"2024-01-0{1 + k % 3} 01:00:00", "prediction", "x" * r.choice([1, 10, 500, 3000, 9000])) for k in range(200)]
    df = spark.createDataFrame(rows, "timestamp string, entry_type string, text string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for part in (df.limit(90), df.exceptAll(df.limit(90))):
        writers.write_audit(part, path, 8000)

    def sizes():
        return [f.stat().st_size for f in (tmp_path / "log").rglob("part-*")]

    def held():
        return sorted((x["text"], str(x["timestamp"])) for x in spark.read.json(path).select("text", "timestamp").collect())

    before, lines = len(sizes()), held()
    assert len(lines) == 200 and max(s for s in sizes() if s < 9000) <= 8000 and all(s < 9200 for s in sizes())
    writers.write_audit(df.limit(0), path, 8000)
    for day in (1, 2, 3):
        writers.compact_audit(spark, path, date(2024, 1, day), 40_000)
    assert held() == lines and len(sizes()) < before / 2 and max(sizes()) <= 40_000
    entries = readers.read_audit(spark, path)
    assert entries.select("event_id").distinct().count() == len({(t, x) for t, _, x in rows}) and "part" not in entries.columns


def test_synonym_variants_against_brute_force(spark):
    synonyms = {**augment.SYNONYMS, "café": ["bar"], "pay": ["spend $1", "a\\b"], "e.g": ["say"]}

    def picked(values, *parts):
        return values[int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16) % len(values)]

    def expected(text, key, synonyms=synonyms):
        for word, values in synonyms.items():
            text = re.sub(rf"\b{re.escape(word)}\b", lambda _, v=picked(values, word, key): v, text, flags=re.IGNORECASE)
        return text

    odd = ["", "THE gift", "théthe the_ the-the", "Café cafés CAFÉ", "pay Pay payé", "e.g this, eXg that", "quick\nquick", "the " * 2000]
    x = views.labelled(spark, SF).select("row_id", "text", "label").unionByName(spark.createDataFrame([(-1 - i, t, "ham") for i, t in enumerate(odd)], "row_id long, text string, label string"))
    key = F.concat(F.col("row_id").cast("string"), F.lit(":1"))
    rows = x.select("row_id", "text", augment.synonym_variant(F.col("text"), key, synonyms).alias("out")).collect()
    assert [r for r in rows if r["out"] != expected(r["text"], f"{r['row_id']}:1")] == []
    assert sum(r["out"] != r["text"] for r in rows) > 20
    given = x.collect()
    wanted = sorted((expected(r["text"], f"{r['row_id']}:{copy}", augment.SYNONYMS), r["label"]) for r in given for copy in (1, 2))
    made = augment.expand_to(x, 2 * len(given)).filter("kind = 'synonym'").collect()
    assert sorted((r["text"], r["label"]) for r in made) == wanted
