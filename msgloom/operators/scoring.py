"""Scoring messages: logits to decisions, pluggable and rule scorers, training, and the firewall's policy."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from msgloom.functions import text as T
from msgloom.operators.quality import LABELS, class_weights
from msgloom.operators.sampling import with_few

THRESHOLD = 0.7


def biased(logits: Column, bias: list[float] | None) -> Column:
    return F.zip_with(logits, F.array(*map(F.lit, bias)), lambda x, y: x + y) if bias else logits


def decision(logits: Column, bias: list[float] | None = None) -> Column:
    """Struct of the first most likely label and its softmax probability."""
    x = biased(logits, bias)
    top = F.array_max(x)
    total = F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    return F.struct(F.get(F.array(*map(F.lit, LABELS)), (F.array_position(x, top) - 1).cast("int")).alias("pred"), (1 / total).alias("conf"))


def decide(df: DataFrame, logits: str = "logits", bias: list[float] | None = None) -> DataFrame:
    return df.withColumn("_d", decision(F.col(logits), bias)).select("*", "_d.*").drop("_d")


#: The last scorers that this worker process has loaded, by the name each use of :func:`score_messages` gives its own.
_loaded: dict[str, Callable] = {}


def _model(name: str, scorer: Callable[[], Callable]) -> Callable:
    if name not in _loaded:
        _loaded[name] = scorer()
        for old in list(_loaded)[:-4]:
            del _loaded[old]
    return _loaded[name]


def _by_length(texts: pd.Series, batch: int) -> Iterator[list[int]]:
    """Positions of texts of like length, ``batch`` at a time, so that none is padded to a much longer one."""
    order = texts.str.len().to_numpy().argsort(kind="stable")
    for at in range(0, len(order), batch):
        yield order[at : at + batch].tolist()


def _scored(model: Callable, texts: pd.Series) -> list[tuple[list[float] | None, str | None]]:
    """Logits or an error of each text; a batch that fails is halved until the rows that fail are alone."""
    try:
        found = [[float(v) for v in row] for row in model(texts)]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} rows of logits for {len(texts)} texts")
        return [(row, None) for row in found]
    except Exception as e:  # whatever a scorer raises is its rows' error
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:500])]
        half = len(texts) // 2
        return _scored(model, texts.iloc[:half]) + _scored(model, texts.iloc[half:])


def score_messages(df: DataFrame, scorer: Callable[[], Callable[[pd.Series], list]], text: str = "text", batch: int = 64, guarded: bool = False) -> DataFrame:
    """``df`` with ``logits``, ``pred`` and ``conf``.

    ``scorer()`` is called once per worker process, and what it gives maps texts to rows of three logits; it sees up to
    ``batch`` of them at a time, of like length. An error fails the job, unless ``guarded``: then rows that fail have it in
    ``error`` (where there was none) and no logits, and all others are scored. A stream is scored like a table.
    """
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(name, scorer)
        for texts in batches:
            texts, found = texts.fillna(""), [(None, None)] * len(texts)
            for own in _by_length(texts, batch):
                part = texts.iloc[own]
                rows = _scored(model, part) if guarded else [([float(v) for v in row], None) for row in model(part)]
                for at, row in zip(own, rows, strict=True):
                    found[at] = row
            yield pd.DataFrame({"logits": pd.Series([x for x, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    score = F.pandas_udf(run, StructType([StructField("logits", ArrayType(DoubleType())), StructField("error", StringType())]))
    out = df.withColumn("_s", score(T.normalize_fast(F.col(text)))).withColumn("logits", F.col("_s.logits"))
    if guarded:
        out = out.withColumn("error", F.coalesce(*(["error"] if "error" in df.columns else []), "_s.error"))
    return decide(out.drop("_s"))


def rule_logits(c: Column) -> Column:
    """Logits from the text's risk score and keywords: no model needed."""
    url, features = T.url_features(c), T.text_features(c)
    risk = T.adversarial_score(c, url, features)
    return F.array(1.0 - risk, F.when(features["emoji_count"] + F.regexp_count(c, F.lit("!")) > 2, 0.6).otherwise(0.1) + risk / 2, risk + 0.1 * features["suspicious_keyword_count"])


def rule_scorer(df: DataFrame, text: str = "text") -> DataFrame:
    return decide(df.withColumn("logits", rule_logits(F.col(text))))


def train_classifier(train: DataFrame, validation: DataFrame, features: int = 1 << 14, penalties: tuple[float, ...] = (0.001, 0.01)):
    """A three-class pipeline with class weights; the penalty with the best macro-F1 on ``validation`` is kept."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    from msgloom.operators.evaluate import macro_f1

    number = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")) - 1
    weights = class_weights(train).select("label", "weight")
    rows = with_few(train, weights, "label").withColumn("target", number.cast("double"))
    best = None
    for penalty in penalties:
        stages = [RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[^\p{L}\p{N}_]+"), HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="x")]
        model = Pipeline(stages=[*stages, LogisticRegression(featuresCol="x", labelCol="target", weightCol="weight", family="multinomial", regParam=penalty, maxIter=30)]).fit(rows)
        scored = classify(model, validation).withColumnRenamed("label", "gold")
        value = macro_f1(scored).first()["macro_f1"]
        if best is None or value > best[0]:
            best = value, model
    return best[1]


def classify(model, df: DataFrame) -> DataFrame:
    pick = F.get(F.array(*map(F.lit, LABELS)), F.col("prediction").cast("int"))
    return model.transform(df).select(*df.columns, pick.alias("pred"))


def apply_policy(df: DataFrame, rules: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``effective_label, action, reason``; ``df`` has ``text, unclassifiable, error, label, conf``, ``rules`` has ``label, action`` (a row a label)."""
    known = rules.select(F.col("label").alias("effective_label"), F.col("action").alias("_rule"))
    why = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty").when(F.col("unclassifiable").isNotNull(), "skipped").when(F.col("error").isNotNull(), "error")
    effective = F.when(why.isNotNull(), None).when(F.col("conf") < threshold, "ham").otherwise(F.col("label"))
    joined = with_few(df.withColumn("_why", why).withColumn("effective_label", effective), known, "effective_label", "left")
    reason = F.coalesce("_why", F.when(F.col("conf") < threshold, "below_threshold"), F.when(F.col("_rule").isNull(), "no_rule").otherwise("rule"))
    return joined.withColumn("action", F.when(F.col("_why").isNotNull(), "forward").otherwise(F.coalesce("_rule", F.lit("forward")))).withColumn("reason", reason).drop("_why", "_rule")
