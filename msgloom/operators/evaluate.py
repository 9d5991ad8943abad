"""Evaluation of predictions (``gold, pred, conf, category, language``): every metric comes from one small table of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from msgloom.operators.quality import LABELS


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), "gold", "pred").agg(F.count("*").alias("n"))


def _over(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _counts(cells: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn and tn of every label from confusion cells."""
    spine = F.explode(F.array(*map(F.lit, LABELS)))
    x = cells.withColumn("label", spine)
    gold, pred = F.col("gold") == F.col("label"), F.col("pred") == F.col("label")
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return x.groupBy(*by, "label").agg(some(gold & pred).alias("tp"), some(~gold & pred).alias("fp"), some(gold & ~pred).alias("fn"), some(~gold & ~pred).alias("tn"))


def per_class(df: DataFrame, by: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where undefined."""
    c = _counts(confusion(df, by), by or [])
    p, r = _over(F.col("tp"), F.col("tp") + F.col("fp")), _over(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumn("p", p).withColumn("r", r).withColumn("f", _over(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    shown = (lambda x: F.bround(x, digits)) if digits is not None else (lambda x: F.col(x))
    return c.select(*(by or []), "label", shown("p").alias("precision"), shown("r").alias("recall"), shown("f").alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def accuracies(df: DataFrame) -> DataFrame:
    """Exact accuracy, and accuracy of ham against the rest."""
    block = (F.col("gold") == "ham") == (F.col("pred") == "ham")
    share = lambda test: F.bround(F.avg(F.when(test, 1.0).otherwise(0.0)), 4)
    return df.agg(F.count("*").alias("n"), share(F.col("gold") == F.col("pred")).alias("accuracy_3class"), share(block).alias("accuracy_block"))


def accuracy_by(df: DataFrame) -> DataFrame:
    """Accuracy over all rows, by category and by language (empty keys dropped)."""
    right = F.when(F.col("gold") == F.col("pred"), 1.0).otherwise(0.0)
    sets = df.withColumn("right", right).groupingSets([[], [F.col("category")], [F.col("language")]], "category", "language").agg(F.count("*").alias("n"), F.bround(F.avg("right"), 4).alias("accuracy"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "category").otherwise("language")
    key = F.coalesce("category", "language", F.lit(""))
    return sets.select(kind.alias("kind"), key.alias("key"), "n", "accuracy").filter((F.col("kind") == "overall") | (F.col("key") != ""))


def macro_f1(df: DataFrame) -> DataFrame:
    """Unweighted mean F1, and precision, recall and F1 weighted by support."""
    c = per_class(df, digits=None)
    weighted = lambda x: F.bround(F.sum(F.col(x) * F.col("support")) / F.sum("support"), 4).alias(f"weighted_{x}")
    return c.agg(F.bround(F.avg("f1"), 4).alias("macro_f1"), *map(weighted, ("precision", "recall", "f1")))


def one_vs_rest(df: DataFrame) -> DataFrame:
    """Counts of each label against the rest, and recall in percent; a failed call (pred ``error``) is a miss."""
    c = _counts(confusion(df), [])
    return c.select("label", "tp", "fp", "fn", "tn", F.bround(100 * _over(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("accuracy"))


def calibration_grid(df: DataFrame, top: float = 2.0, steps: int = 9) -> DataFrame:
    """Metrics of ``logits`` under every (spam, phishing) bias.

    ``df`` has ``gold`` and ``logits``. A row falls into one cell between the grid's thresholds: how many biases leave ham
    before spam, how many leave it before phishing, and, for each bias of spam, how many of phishing stay behind it. Rows are
    counted by cell and gold label, some thousand of them whatever the table, and only these meet the grid.
    """
    values = [-top + 2 * top * k / (steps - 1) for k in range(steps)]
    h, s, p = (F.get("logits", k) for k in range(3))
    below = lambda x, y: sum((F.when(x + b <= y, 1).otherwise(0) for b in values), F.lit(0))
    x = df.select("gold", h.alias("h"), s.alias("s"), p.alias("p"))
    h, s, p = F.col("h"), F.col("s"), F.col("p")
    x = x.select("gold", below(s, h).alias("over_spam"), below(p, h).alias("over_phishing"), F.array(*(below(p, s + a) for a in values)).alias("spam_over"))
    x = x.groupBy("gold", "over_spam", "over_phishing", "spam_over").agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * steps + j).alias("at"), F.lit(a).alias("spam"), F.lit(b).alias("phishing")) for i, a in enumerate(values) for j, b in enumerate(values))))
    x = x.select("*", grid.alias("b"))
    ham = (F.col("b.i") < F.col("over_spam")) & (F.col("b.j") < F.col("over_phishing"))
    pred = F.when(ham, "ham").when(F.col("b.j") < F.get("spam_over", F.col("b.i")), "spam").otherwise("phishing")
    cells = x.select("gold", "b.at", "b.spam", "b.phishing", pred.alias("pred"), "n").groupBy("at", "spam", "phishing", "gold", "pred").agg(F.sum("n").alias("n"))
    by = ["at", "spam", "phishing"]
    c = _counts(cells, by)
    prec, rec = _over(F.col("tp"), F.col("tp") + F.col("fp")), _over(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumn("r", rec).withColumn("f", _over(2 * prec * rec, prec + rec))
    block = F.sum(F.when((F.col("gold") == "ham") == (F.col("pred") == "ham"), F.col("n")).otherwise(0)) / F.sum("n")
    blocks = cells.groupBy(*by).agg(F.bround(block, 4).alias("accuracy_block"), F.bround(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("accuracy_3class"))
    f1 = c.groupBy(*by).agg(F.bround(F.avg("f"), 4).alias("macro_f1"), F.bround(F.max(F.when(F.col("label") == "phishing", F.col("r"))), 4).alias("phishing_recall"))
    return blocks.join(f1, by)


OBJECTIVES = {"macro_f1": ["macro_f1"], "block_then_f1": ["accuracy_block", "macro_f1"], "phishing_recall": ["phishing_recall", "macro_f1"]}


def calibrate(df: DataFrame, objective: str = "macro_f1", top: float = 2.0, steps: int = 9) -> DataFrame:
    """The best bias (first in grid order among ties) and the baseline without one."""
    grid = calibration_grid(df, top, steps)
    best = grid.orderBy(*(F.desc(c) for c in OBJECTIVES[objective]), "at").limit(1).withColumn("kind", F.lit("best"))
    return best.unionByName(grid.filter("spam = 0 and phishing = 0").withColumn("kind", F.lit("baseline"))).drop("at")


def summary(df: DataFrame, key: str = "dataset") -> DataFrame:
    """n, accuracies and phishing recall of each dataset."""
    recall = F.sum(F.when((F.col("gold") == "phishing") & (F.col("pred") == "phishing"), 1).otherwise(0)) / F.nullif(F.count_if(F.col("gold") == "phishing"), F.lit(0))
    share = lambda test: F.bround(F.avg(F.when(test, 1.0).otherwise(0.0)), 4)
    return df.groupBy(key).agg(F.count("*").alias("n"), share(F.col("gold") == F.col("pred")).alias("acc"), share((F.col("gold") == "ham") == (F.col("pred") == "ham")).alias("block"), F.bround(recall, 4).alias("phishing_recall"))


def compare_runs(before: DataFrame, after: DataFrame, key: str = "dataset") -> DataFrame:
    """Two summaries side by side over all datasets of either; an absent one has n = 0."""
    a = before.select(key, *(F.col(c).alias(f"before_{c}") for c in before.columns if c != key))
    b = after.select(key, *(F.col(c).alias(f"after_{c}") for c in after.columns if c != key))
    return a.join(b, key, "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("before_n", "after_n")})


def compare_models(old: DataFrame, new: DataFrame) -> DataFrame:
    """The better of two prediction tables: accuracy, then macro-F1, else the old one."""
    one = lambda df, name: accuracies(df).select(F.col("accuracy_3class").alias(f"{name}_acc")).crossJoin(macro_f1(df).select(F.col("macro_f1").alias(f"{name}_f1")))
    both = one(old, "old").crossJoin(one(new, "new"))
    better = F.when((F.col("new_acc") > F.col("old_acc")) | (F.col("new_acc") == F.col("old_acc")) & (F.col("new_f1") > F.col("old_f1")), "new").otherwise("old")
    return both.withColumn("better", better)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each sample of both runs with its outcome."""
    x = a.select("row_id", "gold", F.col("pred").alias("pred_a"), F.col("conf").alias("conf_a")).join(b.select("row_id", F.col("pred").alias("pred_b"), F.col("conf").alias("conf_b")), "row_id")
    ra, rb = F.col("pred_a") == F.col("gold"), F.col("pred_b") == F.col("gold")
    return x.withColumn("outcome", F.when(ra & rb, "both_right").when(ra, "only_a").when(rb, "only_b").otherwise("both_wrong"))


def paired_comparison(a: DataFrame, b: DataFrame, examples: int = 3) -> DataFrame:
    """Counts and mean confidences of each outcome, with its first ``examples`` rows."""
    first = Window.partitionBy("outcome").orderBy("row_id")
    x = paired(a, b)
    shown = x.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= examples).groupBy("outcome").agg(F.array_join(F.array_sort(F.collect_list("row_id")), ",").alias("examples"))
    return x.groupBy("outcome").agg(F.count("*").alias("n"), F.bround(F.avg("conf_a"), 4).alias("conf_a"), F.bround(F.avg("conf_b"), 4).alias("conf_b")).join(shown, "outcome")


def paired_summary(a: DataFrame, b: DataFrame, time: str = "time") -> DataFrame:
    """Both runs over the samples that they share, in one row: accuracies, the share that ``b`` gains over ``a``, mean times, errors."""
    x = a.select("row_id", "gold", F.col("pred").alias("pred_a"), F.col(time).alias("time_a")).join(b.select("row_id", F.col("pred").alias("pred_b"), F.col(time).alias("time_b")), "row_id")
    right = {k: F.count_if(F.col(f"pred_{k}") == F.col("gold")) for k in "ab"}
    x = x.agg(F.count("*").alias("n"), *(c.alias(f"correct_{k}") for k, c in right.items()), *(F.bround(F.avg(f"time_{k}"), 4).alias(f"time_{k}") for k in "ab"))
    share = lambda c: F.bround(c / F.col("n"), 4)
    return x.select("n", "correct_a", "correct_b", share(F.col("correct_a")).alias("accuracy_a"), share(F.col("correct_b")).alias("accuracy_b"), share(F.col("correct_b") - F.col("correct_a")).alias("improvement"), "time_a", "time_b", (F.col("n") - F.col("correct_a")).alias("errors_a"), (F.col("n") - F.col("correct_b")).alias("errors_b"))


def category_breakdown(df: DataFrame) -> DataFrame:
    """Accuracy, samples and hits of each category and version, over rows that succeeded."""
    right = F.col("gold") == F.col("pred")
    return df.filter("success").groupBy("category", "version").agg(F.bround(F.avg(F.when(right, 1.0).otherwise(0.0)), 4).alias("accuracy"), F.count("*").alias("samples"), F.count_if(right).alias("correct"))


def vulnerabilities(df: DataFrame, old: str = "v1", new: str = "v2", least: float = 0.8) -> DataFrame:
    """Each category's change between versions, flagged where the new one stays under ``least``."""
    acc = category_breakdown(df).groupBy("category").pivot("version", [old, new]).agg(F.first("accuracy"))
    return acc.select("category", F.col(old).alias("old"), F.col(new).alias("new"), F.bround(F.col(new) - F.col(old), 4).alias("delta"), (F.col(new) < least).alias("vulnerable"))


def robustness(df: DataFrame, gap: float = 0.3) -> DataFrame:
    """Success, accuracy, mean confidence of right and wrong answers, and whether their gap is too small."""
    right = F.col("gold") == F.col("pred")
    x = df.groupBy("version").agg(F.bround(F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)), 4).alias("success_rate"), F.avg(F.when(F.col("success") & right, F.col("conf"))).alias("r"), F.avg(F.when(F.col("success") & ~right, F.col("conf"))).alias("w"))
    return x.select("version", "success_rate", F.bround("r", 4).alias("conf_right"), F.bround("w", 4).alias("conf_wrong"), F.bround(F.col("r") - F.col("w"), 4).alias("calibration_gap"), (F.col("r") - F.col("w") < gap).alias("flagged"))


def error_patterns(df: DataFrame, k: int = 5, low: float = 0.8) -> DataFrame:
    """The ``k`` most frequent errors: counts, text lengths, and how many had little confidence."""
    x = df.filter(F.col("gold") != F.col("pred")).groupBy("gold", "pred").agg(F.count("*").alias("n"), F.bround(F.avg(F.length("text")), 4).alias("avg_length"), F.count_if(F.col("conf") < low).alias("unsure"))
    return x.orderBy(F.desc("n"), "gold", "pred").limit(k)


def error_texts(df: DataFrame) -> DataFrame:
    """All wrongly labelled texts under their pair ``gold_to_pred``, with length and confidence."""
    return df.filter(F.col("gold") != F.col("pred")).select(F.concat_ws("_to_", "gold", "pred").alias("pair"), "row_id", "text", F.length("text").alias("length"), "conf")


def low_confidence(df: DataFrame, t: float = 0.8) -> DataFrame:
    """Rows under ``t``, where a wrong answer's confidence counts as its complement."""
    own = F.when(F.col("gold") == F.col("pred"), F.col("conf")).otherwise(1 - F.col("conf"))
    return df.withColumn("confidence", own).filter(F.col("confidence") < t)
