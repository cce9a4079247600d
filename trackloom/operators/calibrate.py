"""Platt calibration: a logistic fit per action (and fold) by Newton steps over grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import platt, sigmoid
from ..functions.sizes import broadcast_if_small

#: Longest Newton step in either parameter.
MOST = 5.0


def fit_platt(scores: DataFrame, by: Sequence[str] = ("action",), steps: int = 25) -> DataFrame:
    """(by, a, b, prior): y ~ sigmoid(a*score + b) from columns ``score`` and ``y``; one class alone gives (1, 0).

    Each Newton step is one grouped aggregate of five sums and the loss; parameters, one row per group, are broadcast back.
    A step that would raise its group's loss is halved until it does not; steps end where the curvature is gone.
    """
    by = list(by)
    rows = scores.where("score is not null and y is not null").select(*by, F.col("score").cast("double").alias("x"), F.col("y").cast("double").alias("y")).cache()
    spark = scores.sparkSession
    start = rows.groupBy(*by).agg(F.avg("y").alias("prior"), F.min("y").alias("low"), F.max("y").alias("high"))
    # one small record per group on the driver: the accepted point, its loss, and the point under trial
    state = {tuple(r[k] for k in by): {"prior": r["prior"], "both": r["low"] < r["high"], "a": 1.0, "b": 0.0, "loss": None, "step": (0.0, 0.0), "share": 1.0} for r in start.collect()}
    kinds = ", ".join(f"`{k}` {scores.schema[k].dataType.simpleString()}" for k in by)
    todo = {k for k, v in state.items() if v["both"]}
    for _ in range(4 * steps):
        if not todo:
            break
        tried = [(*k, *(state[k][n] + state[k]["share"] * d for n, d in zip("ab", state[k]["step"], strict=True))) for k in todo]
        params = spark.createDataFrame(tried, f"{kinds}, a double, b double")
        z = F.col("a") * F.col("x") + F.col("b")
        p = sigmoid(z)
        r, h = F.col("y") - p, p * (1 - p)
        # log(1 + exp(z)) - y*z, without overflow
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
        sums = rows.join(broadcast_if_small(params), by).groupBy(*by, "a", "b").agg(
            F.sum(loss).alias("loss"), F.sum(r).alias("gb"), F.sum(r * F.col("x")).alias("ga"), F.sum(h).alias("hbb"), F.sum(h * F.col("x")).alias("hab"), F.sum(h * F.col("x") * F.col("x")).alias("haa")
        )
        for row in sums.collect():
            key = tuple(row[k] for k in by)
            own = state[key]
            if own["loss"] is not None and row["loss"] > own["loss"] + 1e-12 * abs(own["loss"]):
                own["share"] /= 2
                if own["share"] < 1e-6:
                    todo.discard(key)
                continue
            moved = abs(row["a"] - own["a"]) + abs(row["b"] - own["b"])
            first = own["loss"] is None
            own.update(a=row["a"], b=row["b"], loss=row["loss"], share=1.0)
            det = row["haa"] * row["hbb"] - row["hab"] ** 2
            if det <= 1e-12 or (not first and moved < 1e-9):
                todo.discard(key)
            else:
                step = ((row["ga"] * row["hbb"] - row["gb"] * row["hab"]) / det, (row["gb"] * row["haa"] - row["ga"] * row["hab"]) / det)
                # where scores saturate the curvature says little
                scale = min(1.0, MOST / max(abs(step[0]), abs(step[1]), 1e-12))
                own["step"] = (step[0] * scale, step[1] * scale)
    rows.unpersist()
    return spark.createDataFrame([(*k, v["a"], v["b"], v["prior"]) for k, v in state.items()], f"{kinds}, a double, b double, prior double")


def apply_platt(scores: DataFrame, params: DataFrame, by: Sequence[str] = ("action",)) -> DataFrame:
    """Adds ``calibrated``: log-odds relative to the action's prior. Parameters are one row per group."""
    joined = scores.join(broadcast_if_small(params), list(by), "left")
    return joined.withColumn("calibrated", platt(F.col("score"), F.col("a"), F.col("b"), F.col("prior"))).select(*scores.columns, "calibrated")


def mean_margins(scores: DataFrame, keys: Sequence[str], by: Sequence[str] = ("action",)) -> DataFrame:
    """One row per key: the mean margin over folds, its label, and the last fold that it stands in."""
    return scores.groupBy(*keys, *by).agg(F.avg("score").alias("score"), F.max("y").alias("y"), F.max("fold").alias("fold"))


def cross_fit(scores: DataFrame, keys: Sequence[str], by: Sequence[str] = ("action",)) -> DataFrame:
    """Mean margins, each row calibrated by a fit on the rows of other folds (column ``fold``: its last one).

    Rows outside a fold must hold both classes.
    """
    means = mean_margins(scores, keys, by)
    folds = sorted(r[0] for r in means.select("fold").distinct().collect())
    # every row stands in the training part of all folds but its own
    parts = means.withColumn("own", F.col("fold")).withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds]))).where("fold <> own").drop("own")
    classes = parts.groupBy(*by, "fold").agg(F.count_distinct("y").alias("n")).where("n < 2").collect()
    if classes or len(folds) < 2:
        at = [tuple(r[k] for k in (*by, "fold")) for r in classes] or "a single fold"
        raise ValueError(f"calibration needs both classes outside each fold: {at}")
    return apply_platt(means, fit_platt(parts, [*by, "fold"]), [*by, "fold"])
