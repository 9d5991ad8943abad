"""Goldens of the text functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from msgloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("char", T.INVISIBLE)
def test_invisible_characters_go(spark, char):
    assert one(spark, f"V{char}e{char}rify", T.normalize_unicode) == "Verify"


def test_lookalikes_fold_and_keep_case(spark):
    assert len(T.INVISIBLE) == 15 and len(T.HOMOGLYPHS) == 13
    assert one(spark, "раох", T.normalize_unicode) == "paox"
    assert one(spark, "А", T.normalize_unicode) == "A"
    assert one(spark, "у", T.normalize_unicode) == "u"


def test_plain_text_is_not_changed(spark):
    assert one(spark, "Hello, world! 123", T.normalize_fast) == "Hello, world! 123"
    assert one(spark, None, T.normalize_fast) is None
    assert one(spark, "café", T.normalize_fast) == "café"


@pytest.mark.parametrize(
    "given, want",
    [("a   b\t c", "a b c"), ("see http://x.com/a now", "see [URL] now"), ("call 4155550100 now", "call [PHONE] now"), ("mail bob@example.com now", "mail [EMAIL] now"), ("what?!!", "what!")],
)
def test_mask_entities(spark, given, want):
    assert one(spark, given, T.mask_entities) == want


def test_hash(spark):
    x = one(spark, "abc", T.text_hash)
    assert x == one(spark, "abc", T.text_hash) and x.startswith("sha256:") and len(x) == 71


def test_redaction_order_matters(spark):
    url = "https://x.com/?u=a@b.com"
    both = one(spark, url, lambda c: T.redact(c, ["email_addresses", "urls"])["redacted_entities"])
    first = one(spark, url, lambda c: T.redact(c, ["urls", "email_addresses"])["redacted_entities"])
    assert both == ["email_addresses", "urls"] and first == ["urls"]


@pytest.mark.parametrize("code, charset, text", [(7, "iso-8859-8", "שלום"), (6, "iso-8859-5", "Привет"), (8, "utf-16-be", "漢字"), (14, "cp949", "한국"), (0, "utf-8", "plain é")])
def test_decode_payload(spark, code, charset, text):
    row = spark.createDataFrame([(None, bytearray(text.encode(charset)), code)], "s binary, p binary, c int")
    assert row.select(T.decode_payload(F.col("s"), F.col("p"), F.col("c")).alias("x")).first()["x"] == text


@pytest.mark.parametrize("udh, code, want", [(None, 10, "data_coding_0x0A"), ([b"\x24\x01\x05"], 0, "national_language_table"), ([b"\x24\x01\x03"], 0, None), (None, 8, None)])
def test_unclassifiable(spark, udh, code, want):
    row = spark.createDataFrame([([bytearray(x) for x in udh] if udh else None, code)], "u array<binary>, c int")
    assert row.select(T.unclassifiable_reason(F.col("u"), F.col("c")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("n, want", [(0, 1), (1, 1), (2, 2), (3, 4), (64, 64), (65, 128)])
def test_batch_bucket(spark, n, want):
    assert spark.range(n, n + 1).select(T.batch_bucket(F.col("id")).alias("x")).first()["x"] == want


def test_validate_request(spark):
    assert one(spark, "  ok ", T.validate_request)["text"] == "ok"
    assert one(spark, "   ", T.validate_request)["reason"] == "blank"
    assert one(spark, "x" * 513, T.validate_request)["reason"] == "too_long"
    assert one(spark, "", T.validate_request)["reason"] == "empty"


def test_event_times_with_two_zones(spark):
    for written in ("2026-03-03T23:54:04+00:00Z", "2026-03-03T23:54:04Z", "2026-03-03T23:54:04"):
        assert str(one(spark, written, T.parse_event_time)) == "2026-03-03 23:54:04"


def test_two_places_go_by_the_exact_value(spark):
    rng = random.Random(23)
    ties = [n / 8 for n in range(0, 2000)] + [(10 * n + 5) / 1000 for n in range(0, 12000)]
    values = [*ties, *(rng.random() * 10 ** rng.randint(-8, 8) for _ in range(5000)), 0.0, 1e-300, 0.29 * 100, 999999999.995, 1e12]
    values += [math.nextafter(v, way) for v in ties[::7] for way in (-1.0, 1e9)]
    values += [-v for v in values[1:3000]]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.two_places(F.col("v")).alias("out"))
    wrong = [(r["v"], r["out"]) for r in df.collect() if r["out"] != f"{r['v']:.2f}"]
    assert not wrong, wrong[:10]
    assert [r[0] for r in spark.createDataFrame([(None,), (float("nan"),)], "v double").select(T.two_places(F.col("v"))).collect()] == [None, "NaN"]
