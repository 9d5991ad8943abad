"""Order statistics by selection equal those of sorted lists, whatever the limits; latency figures of large groups."""

import io
import random
import statistics
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from msgloom.operators import selection, traffic


def ranks(n):
    return [F.lit(0), F.floor(n / 2), F.floor(n * 95 / 100), n - 1, n, F.lit(-1)]


def of(values):
    own = sorted(values)
    n = len(own)
    return [own[0], own[n // 2], own[n * 95 // 100], own[-1], None, None]


@pytest.mark.parametrize("limit,bins", [(1, 2), (20, 4), (50, 16), (10_000, 128)])
def test_against_sorting(spark, limit, bins):
    r = random.Random(3)
    rows = [("ties", r.choice([1.0, 2.0, 2.0, 3.0])) for _ in range(300)] + [("spread", r.uniform(-9, 9)) for _ in range(400)] + [(None, r.gauss(0, 1) ** 3) for _ in range(200)]
    rows += [("one", 5.0), ("none", None), ("same", 7.0), ("odd", float("inf")), ("odd", float("-inf")), ("odd", 0.0)] + [("same", 7.0)] * 80 + [("spread", None)] * 20
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: x["at"] for x in selection.values_at(df, ["g"], F.col("v"), ranks, limit, bins).collect()}
    want = {g: of([v for k, v in rows if k == g and v is not None]) for g in {k for k, _ in rows} - {"none"}}
    assert got == want
    everything = selection.values_at(df, [], F.col("v"), ranks, limit, bins).collect()
    assert [x["at"] for x in everything] == [of([v for _, v in rows if v is not None])]
    assert selection.values_at(df.limit(0), ["g"], F.col("v"), ranks).count() == 0


def test_latency_of_a_large_group(spark):
    """A group of different times goes through several rounds; nothing orders its rows in one window."""
    df = spark.range(60_000).select((F.col("id") % 97 == 0).alias("few"), (F.col("id") % 50 != 0).alias("success"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e6).alias("response_time"))
    stats = traffic.latency_stats(df, ["few"])
    with redirect_stdout(io.StringIO()) as out:
        stats.explain()
    assert "Window" not in out.getvalue()
    rows = df.filter("success").collect()
    for x in stats.collect():
        own = sorted(r["response_time"] for r in rows if r["few"] == x["few"])
        assert x["ok"] == len(own) and x["median"] == pytest.approx(own[len(own) // 2], abs=1e-4)
        assert x["p95_exclusive"] == pytest.approx(statistics.quantiles(own, n=20)[18], abs=1e-4) and x["p99_exclusive"] == pytest.approx(statistics.quantiles(own, n=100)[98], abs=1e-4)
        assert x["p95_index"] == pytest.approx(own[int(len(own) * 0.95)], abs=1e-4) and x["p99_index"] == pytest.approx(own[int(len(own) * 0.99)], abs=1e-4)
