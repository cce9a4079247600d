"""Column expressions with the missing-value rules of tracking data: missing is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_max(c: Column, floor: float) -> Column:
    """Floored value; missing stays missing (plain ``greatest`` would return the floor)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the values that are present in a row."""
    if not columns:
        return F.lit(None).cast("double")
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(count > 0, total / count)


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def wrap_angle(d: Column) -> Column:
    return F.atan2(F.sin(d), F.cos(d))


def half_even(c: Column) -> Column:
    return F.rint(c).cast("int")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def clip(c: Column, eps: float = 1e-6) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps)
    return F.log(q / (1 - q))


def platt(score: Column, a: Column, b: Column, prior: Column, eps: float = 1e-6) -> Column:
    """Calibrated log-odds less the prior's log-odds, in single precision."""
    return (logit(sigmoid(a * score + b), eps) - logit(prior, eps)).cast("float")


def fbeta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    b2 = float(beta) ** 2
    top = F.lit(1 + b2) * tp
    bottom = top + F.lit(b2) * fn + fp
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def mouse_name(c: Column) -> Column:
    return F.concat(F.lit("mouse"), c.cast("string"))
