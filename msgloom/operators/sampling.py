"""Deterministic sampling, balancing and splitting: "random" order is the MD5 of a seed and the row's key.

The same rows are drawn whatever the partitioning. A handful of labels must not mean a handful of tasks: ``row_number()
<= n`` with a fixed ``n`` is also applied before the shuffle (window group limit), and full ranks are put together from
ranks inside ``16**PREFIX`` ranges of the hash and the counts of the ranges below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from msgloom.functions.text import hash_number


def order_key(key: str, seed: int | str = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def _rank(by: list[str], key: str, seed: int | str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(order_key(key, seed), key))


PREFIX = 3


#: Up to so many rows a label, each task cuts its own rows before they are moved; larger numbers go by :func:`ranked`.
FEW = 1000


def ranked(df: DataFrame, by: str, key: str, seed: int | str) -> DataFrame:
    """``df`` with ``_r``, its rank in hash order among the rows of equal ``by`` (null is a value, too), and their number ``_size``."""
    x = df.withColumn("_o", order_key(key, seed)).withColumn("_b", F.substring("_o", 1, PREFIX))
    counts = x.groupBy(F.col(by).alias("_by"), F.col("_b").alias("_range")).agg(F.count("*").alias("_c"))
    own = Window.partitionBy("_by")
    below = F.coalesce(F.sum("_c").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_below": below, "_size": F.sum("_c").over(own)}).drop("_c")
    x = x.withColumn("_in", F.row_number().over(Window.partitionBy(by, "_b").orderBy("_o", key)))
    x = x.join(counts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_b").eqNullSafe(F.col("_range")))
    return x.withColumn("_r", F.col("_below") + F.col("_in")).select(*df.columns, "_r", "_size")


def sample_per_label(df: DataFrame, n: int, label: str = "label", key: str = "row_id", seed: int | str = 42) -> DataFrame:
    """``n`` rows of each label at most."""
    x = df.withColumn("_r", _rank([label], key, seed)) if n <= FEW else ranked(df, label, key, seed)
    return x.filter(F.col("_r") <= n).select(*df.columns)


def undersample(df: DataFrame, n: int | None = None, label: str = "label", key: str = "row_id", seed: int | str = 42) -> DataFrame:
    """Every class down to ``n`` rows (default: the smallest class's)."""
    if n is not None:
        return sample_per_label(df, n, label, key, seed)
    least = df.groupBy(label).agg(F.count("*").alias("c")).agg(F.min("c").alias("_n"))
    return ranked(df, label, key, seed).crossJoin(F.broadcast(least)).filter(F.col("_r") <= F.col("_n")).select(*df.columns)


def cap_class(df: DataFrame, value: str = "ham", n: int = 50000, label: str = "label", key: str = "row_id", seed: int | str = 42) -> DataFrame:
    """One class down to ``n`` rows, the others (null too) whole."""
    one = F.col(label).eqNullSafe(F.lit(value))
    return df.filter(~one).unionByName(sample_per_label(df.filter(one), n, label, key, seed))


def stratified_sample(df: DataFrame, n: int, by: str = "language", key: str = "row_id", seed: int | str = 42) -> DataFrame:
    """About ``n`` rows, each stratum (null too) in proportion (half-even), one at least."""
    total = df.agg(F.count("*").alias("_total"))  # one row
    share = F.greatest(F.lit(1), F.bround(F.col("_size") * n / F.col("_total"), 0))
    return ranked(df, by, key, seed).crossJoin(F.broadcast(total)).filter(F.col("_r") <= share).select(*df.columns)


def stratified_split(df: DataFrame, fractions: dict[str, float], rest: str, label: str = "label", key: str = "row_id", seed: int | str = 42, least: int = 0) -> DataFrame:
    """``df`` with ``split``: of each label (null too), ``int(size * fraction)`` rows (``least`` at least) for each name in turn, then ``rest``."""
    test, upto = None, F.lit(0)
    for name, share in fractions.items():
        upto = upto + F.greatest(F.lit(least), F.floor(F.col("_size") * share + 1e-9))
        test = F.when(F.col("_r") <= upto, name) if test is None else test.when(F.col("_r") <= upto, name)
    return ranked(df, label, key, seed).withColumn("split", test.otherwise(rest)).select(*df.columns, "split")


def random_split(df: DataFrame, share: float = 0.1, key: str = "row_id", seed: int | str = 42) -> DataFrame:
    """``df`` with ``held``: about ``share`` of the rows, by a threshold on the hash."""
    return df.withColumn("held", hash_number(F.lit(str(seed)), F.col(key)) < int(share * (1 << 32)))


#: The largest mean of one ladder: a larger one is the sum of independent pieces.
PIECE = 64


def _rungs(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... up to beyond all numbers of 32 bits, for a mean up to ``PIECE``."""
    none = F.exp(-mean)
    start = F.struct(none.alias("p"), none.alias("upto"), F.array(none).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["upto"] + p).alias("upto"), F.concat(s["all"], F.array(s["upto"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(mean + 8 * F.sqrt(mean) + 16).cast("int")), start, step, lambda s: s["all"])


def _drawn(rungs: Column, u: Column) -> Column:
    return F.size(F.filter(rungs, lambda upto: upto <= u))


def balanced_resample(df: DataFrame, label: str = "label", key: str = "row_id", seed: int | str = 42) -> DataFrame:
    """Rows drawn with replacement so that all labels (null too) are expected equally often; ``copy`` numbers the draws.

    A row's copies are a Poisson count without an upper limit: one draw up to a mean of ``PIECE``, and beyond that one more,
    with a hash of its own, for each further ``PIECE``.
    """
    sizes = df.groupBy(F.col(label).alias("_by")).agg(F.count("*").alias("_size"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("_size").alias("_total"), F.count("*").alias("_k")))).select("_by", (F.col("_total") / (F.col("_k") * F.col("_size"))).alias("_mean"))
    sizes = sizes.withColumn("_more", F.greatest(F.ceil(F.col("_mean") / PIECE) - 1, F.lit(0)).cast("int"))
    sizes = sizes.select("_by", "_more", _rungs(F.col("_mean") - PIECE * F.col("_more")).alias("_rungs"), F.when(F.col("_more") > 0, _rungs(F.lit(float(PIECE)))).alias("_whole"))
    u = lambda *piece: hash_number(F.lit(str(seed)), F.col(key), *piece) / float(1 << 32)
    more = F.aggregate(F.sequence(F.lit(1), F.col("_more")), F.lit(0), lambda n, i: n + _drawn(F.col("_whole"), u(i)))
    x = with_few(df, sizes, F.col(label).eqNullSafe(F.col("_by")))
    x = x.withColumn("_n", _drawn(F.col("_rungs"), u()) + F.when(F.col("_more") > 0, more).otherwise(0))
    return x.filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*df.columns, "copy")


def with_few(df: DataFrame, few: DataFrame, on: Column | str, how: str = "inner", most: int = 10_000) -> DataFrame:
    """``df`` joined with ``few``, which is broadcast if it is counted to hold ``most`` rows or fewer."""
    small = few.limit(most + 1).count() <= most
    return df.join(F.broadcast(few) if small else few, on, how)


def rehearsal_mix(new: DataFrame, old: DataFrame, n: int = 2500, label: str = "label", key: str = "row_id", seed: int | str = 42) -> DataFrame:
    """All of ``new`` and ``n`` rows of each label of ``old``, in shuffled order."""
    return shuffle(new.unionByName(sample_per_label(old, n, label, key, seed)), key, seed)


def take_sample(df: DataFrame, n: int, key: str = "row_id", seed: int | str = 42) -> DataFrame:
    return df.orderBy(order_key(key, seed), key).limit(n)


def shuffle(df: DataFrame, key: str = "row_id", seed: int | str = 42) -> DataFrame:
    return df.orderBy(order_key(key, seed), key)
