"""Queries over texts hold their SQL on odd texts too."""

import os

import pytest

from msgloom.plans import registry
from tests.conftest import SF
from tests.oracle import TABLES, same

#: Each comes as twenty rows, so that every kind of noise and storage meets it.
ODD = [
    'token = "2494638875a0bf3d57" and "e8781115996afb90" here',  # letters beyond ASCII beside numbers
    "é555-123-4567é und 4111 1111 1111 1111é, é123-45-6789é, http://192.168.0.1/é 10.0.0.1é",
    "ébob@example.comé |amy@example.org| _x@example.net_",
    "a\x1c\x1d b\x1e\x1f\x85c\u2028d",
    "",
    "a\n\n\n\n\n\nb",
    *(x * 5 for x in ("\r", "\x85", "\u2028", "Σ", "é", "😀", "\0", "e\u0301")),
    "iİiİi",
    "Test",
    "lorem İpsum",
    None,
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    spark.createDataFrame([(20 * i + k, x) for i, x in enumerate(ODD) for k in range(20)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "length(text) AS n_chars").toPandas().to_parquet(path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["t05_mask_entities", "t06_url_features", "t11_redact", "t12_text_storage", "a05_suspicious_patterns"])
def test_query(spark, odd, name):
    got, want = same(spark, odd, registry.queries()[name], registry.oracle_sql()[name])
    assert got == want
