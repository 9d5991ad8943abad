"""Exact order statistics of groups by distributed selection: no group is sorted, or in one task.

A quantile sketch (mergeable, so built where the rows are) gives each large group some splitters. Rows fall into the cells
between them, or on one of them; cells are counted, and only the cells that hold a wanted rank are gone into, with splitters
of their own, until they have at most ``LIMIT`` rows. A cell on a splitter has one value and is done, so ties don't delay the
search. Each round keeps about one in ``BINS / ranks`` of the rows it read. Only counts are shuffled, and the rows of
the small cells at the end, each sorted as one array.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgloom.operators.sampling import with_few
from msgloom.sources.scratch import written

LIMIT, BINS = 10_000, 128


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b)))


def _within(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` of the given cells, with what ``cells`` says of them."""
    other = [f"_{k}" for k in keys]
    named = cells.select(*(F.col(k).alias(o) for k, o in zip(keys, other)), *(c for c in cells.columns if c not in keys))
    return with_few(rows, named, _same(keys, other)).drop(*other).filter(F.col("_of"))


def values_at(df: DataFrame, by: list[str], value: Column, ranks: Callable[[Column], list[Column]], limit: int = LIMIT, bins: int = BINS) -> DataFrame:
    """``by`` and ``at``: each group's values at ``ranks(n)`` (from 0) among its ``n`` that are not null; null outside them."""
    groups = [f"_g{i}" for i in range(len(by))] or ["_g"]
    own = [F.col(c).alias(g) for c, g in zip(by, groups)] or [F.lit(0).alias("_g")]
    keys = [*groups, "_cell"]
    rows = df.select(*own, F.lit("").alias("_cell"), value.cast("double").alias("_v")).filter("_v is not null")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    wanted = sizes.select(*keys, F.col("_n"), F.posexplode(F.array(*(r.cast("long") for r in ranks(F.col("_n"))))).alias("_k", "_rank"))
    wanted = written(wanted.withColumn("_value", F.lit(None).cast("double")), "ranks")
    count = len(ranks(F.lit(0).cast("long")))
    searched, small = wanted.filter((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_n"))), []
    while searched.filter(F.col("_value").isNull() & (F.col("_n") > limit)).take(1):
        is_large = F.col("_value").isNull() & (F.col("_n") > limit)
        cells = searched.filter("_value is null").groupBy(*keys).agg(F.max("_n").alias("_n"))
        few = cells.filter(F.col("_n") <= limit).select(*keys, F.lit(True).alias("_of"))
        small.append(_within(rows, few, keys).select(*keys, "_v"))
        large = _within(rows, cells.filter(F.col("_n") > limit).select(*keys, F.lit(True).alias("_of")), keys).drop("_of")
        shares = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
        cuts = large.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", shares, 20 * bins)).alias("_cuts"))
        placed = _within(large, written(cuts.withColumn("_of", F.lit(True)), "cuts"), keys)
        spot = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        placed = placed.withColumn("_spot", spot)
        counts = placed.groupBy(*keys, "_spot").agg(F.count("*").alias("_c"), F.min("_v").alias("_least"))
        listed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_spot", "_c", "_least"))).alias("_spots"))
        start = F.transform("_spots", lambda x, i: F.struct(F.aggregate(F.slice("_spots", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["_c"]).alias("start"), x.alias("x")))
        listed = written(listed.select(*keys, start.alias("_spots"), F.lit(True).alias("_of")), "spots")
        found = _within(searched.filter(is_large), listed, keys)
        one = F.filter("_spots", lambda x: (x["start"] <= F.col("_rank")) & (F.col("_rank") < x["start"] + x["x"]["_c"]))[0]
        found = found.withColumn("_one", one)
        cell = F.concat("_cell", F.lit("/"), F.col("_one.x._spot").cast("string"))
        value_ = F.when(F.col("_one.x._spot") % 2 == 1, F.col("_one.x._least"))
        found = found.select(*groups, cell.alias("_cell"), F.col("_one.x._c").alias("_n"), "_k", (F.col("_rank") - F.col("_one.start")).alias("_rank"), value_.alias("_value"))
        searched = written(searched.filter(~is_large).unionByName(found), "ranks")
        inner = searched.filter("_value is null").select(*keys, F.lit(True).alias("_of")).distinct()
        deeper = placed.select(*groups, F.concat("_cell", F.lit("/"), F.col("_spot").cast("string")).alias("_cell"), "_v")
        rows = written(_within(deeper, inner, keys).select(*keys, "_v"), "cells")
    rest = searched.filter("_value is null").select(*keys, F.lit(True).alias("_of")).distinct()
    small.append(_within(rows, rest, keys).select(*keys, "_v") if small else rows)
    lists = reduce(DataFrame.unionByName, small).groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_list"), F.lit(True).alias("_of"))
    ends = searched.filter("_value is not null").select(*groups, "_k", "_value")
    picked = searched.filter("_value is null").join(lists.drop("_of").select(*(F.col(k).alias(f"_{k}") for k in keys), "_list"), _same(keys, [f"_{k}" for k in keys]))
    ends = ends.unionByName(picked.select(*groups, "_k", F.element_at("_list", (F.col("_rank") + 1).cast("int")).alias("_value")))
    by_k = ends.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_value"))).alias("_at"))
    at = F.array(*(F.try_element_at("_at", F.lit(k)) for k in range(count)))
    return by_k.select(*(F.col(g).alias(c) for c, g in zip(by, groups)), at.alias("at"))
