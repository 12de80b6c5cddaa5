"""Classifier metrics, splits and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import count_when, ratio
from flowtide.functions.ordered import cut, scan


def binary_metrics(scored: DataFrame, prob: str = "p", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Confusion counts and rates in one pass; a rate without cases is 0."""
    y = F.col(label) == 1
    hit = F.col(prob) >= F.lit(float(threshold))
    counts = scored.agg(
        count_when(~y & ~hit).alias("tn"), count_when(~y & hit).alias("fp"),
        count_when(y & ~hit).alias("fn"), count_when(y & hit).alias("tp"),
        F.count(F.lit(1)).alias("total_samples"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "*",
        ratio(tp + tn, F.col("total_samples")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
        ratio(fn, fn + tp).alias("false_negative_rate"),
        F.lit(float(threshold)).alias("threshold_used"),
    )


def roc_auc(scored: DataFrame, prob: str = "p", label: str = "label") -> DataFrame:
    """Exact area under the ROC curve; equal scores count half.

    Null if one class is absent. Rows are first counted per distinct score. The running count over scores is range-partitioned, so
    no task sees more than its part of the scores.
    """
    y = F.col(label) == 1
    per_score = scored.groupBy(F.col(prob).alias("score")).agg(
        count_when(y).alias("pos"), count_when(~y).alias("neg")
    )
    placed, lane = cut(per_score, (), ["score"], name="auc")
    upto = scan(placed, lane, total={"neg_upto": F.col("neg")})
    exact = "decimal(19,0)"
    pairs = F.col("pos").cast(exact) * (2 * F.col("neg_upto") - F.col("neg")).cast(exact)
    return upto.agg(
        F.sum(pairs).cast("double").alias("_twice"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    ).select(
        F.try_divide(F.col("_twice"), 2.0 * F.col("positives") * F.col("negatives")).alias("roc_auc"),
        "positives", "negatives",
    )


def multiclass_metrics(rows: DataFrame, truth: Column, predicted: Column, normal: str = "Normal") -> DataFrame:
    return rows.agg(
        ratio(count_when(truth == predicted), F.count(F.lit(1))).alias("accuracy"),
        ratio(count_when((truth == normal) == (predicted == normal)), F.count(F.lit(1))).alias("binary_accuracy"),
    )


def champion(candidates: dict[str, DataFrame], tie: str) -> DataFrame:
    """Row of the model with the higher F1; ``tie`` names the model that wins a draw."""
    rows = [df.select(F.lit(n).alias("model"), "f1_score") for n, df in candidates.items()]
    every = reduce(DataFrame.unionByName, rows)
    return every.agg(F.max_by("model", F.struct("f1_score", F.col("model") == tie)).alias("champion"), F.max("f1_score").alias("f1_score"))


def split_share(key: Column) -> Column:
    """A number 0..99 that depends on the key alone."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100


def train_val_split(rows: DataFrame, key: str = "id", share: int = 80) -> DataFrame:
    """Shuffle-free split, the same at any partitioning and in every run."""
    return rows.withColumn("split", F.when(split_share(F.col(key)) < share, "train").otherwise("validation"))


def sample_per_class(rows: DataFrame, n: int = 3, label: str = "label", order: str = "id", values=(0, 1)) -> DataFrame:
    """The first n rows of each class; each class is a bounded top-n, whatever its size."""
    firsts = [rows.filter(F.col(label) == v).orderBy(order).limit(n) for v in values]
    return reduce(DataFrame.unionByName, firsts)
