"""Holdout metrics as aggregates (nothing is collected but the final numbers).

MLlib's ``f1`` is the support-weighted F1, so macro-F1 is written out:
per class true positives, false positives and false negatives in one
grouped pass, then the unweighted mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def macro_f1(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Unweighted mean over classes (seen as label or prediction) of per-class F1;
    a class with no true positive scores 0."""
    pairs = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return _macro_f1(pairs)


def weighted(pred: DataFrame, weight: str, task_type: str, label: str = "label", prediction: str = "prediction") -> dict:
    """``score`` of rows that stand for ``weight`` rows each."""
    w = F.col(weight)
    if task_type == "regression":
        y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
        mean = pred.agg(F.sum(y * w) / F.sum(w)).first()[0]
        s = pred.agg(F.sum(w * (y - p) * (y - p)).alias("res"), F.sum(w * (y - F.lit(mean)) * (y - F.lit(mean))).alias("tot")).first()
        return {"r2": 1.0 - s["res"] / s["tot"] if s["tot"] else None}
    pairs = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.sum(w).alias("n"))
    row = _macro_f1(pairs).crossJoin(pairs.agg((F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))).first()
    return {"accuracy": row["accuracy"], "macro_f1": row["macro_f1"]}


def _macro_f1(pairs: DataFrame) -> DataFrame:
    as_label = pairs.groupBy(F.col("y").alias("cls")).agg(
        F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0)).alias("fn"),
    )
    as_pred = pairs.groupBy(F.col("p").alias("cls")).agg(
        F.sum(F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0)).alias("fp")
    )
    per = as_label.join(as_pred, "cls", "full").na.fill(0, ["tp", "fn", "fp"])
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(F.lit(0.0))
    return per.agg(F.avg(f1).alias("macro_f1"))


def r2(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """1 - SS_res / SS_tot in one pass (SS_tot from the population variance, which does not cancel)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    s = pred.agg(
        F.sum((y - p) * (y - p)).alias("ss_res"),
        F.var_pop(y).alias("var"), F.count(y).alias("n"),
    )
    ss_tot = F.col("var") * F.col("n")
    return s.select((F.lit(1.0) - F.col("ss_res") / ss_tot).alias("r2"))


def score(pred: DataFrame, task_type: str, label: str = "label", prediction: str = "prediction") -> dict:
    """accuracy + macro_f1 for classification, r2 for regression."""
    if task_type == "regression":
        return {"r2": r2(pred, label, prediction).first()["r2"]}
    a = accuracy(pred, label, prediction).first()["accuracy"]
    f = macro_f1(pred, label, prediction).first()["macro_f1"]
    return {"accuracy": a, "macro_f1": f}
