"""Windows whose lag or width is a column.

Spark wants literal offsets and frame bounds. The number of distinct values is tiny (one per frame
rate or per action), so each becomes one branch over the same partitioning and order: one exchange and
one sort serve all branches. Long frames come from running sums instead, which cost the same for
any width.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Half-widths beyond this are computed from running sums.
DIRECT_ROWS = 64


def ordered(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def distinct_values(dim: DataFrame, column: str) -> list[int]:
    """Distinct non-null values of a dimension's column. ``dim`` has a row per recording or action, not per frame."""
    return sorted(int(r[0]) for r in dim.select(column).where(F.col(column).isNotNull()).distinct().collect())


def by_value(selector: Column, values: Sequence[int], branch: Callable[[int], Column]) -> Column:
    if not values:
        return F.lit(None)
    out = None
    for v in values:
        out = F.when(selector == v, branch(v)) if out is None else out.when(selector == v, branch(v))
    return out


def lagged(c: Column, k: Column, values: Sequence[int], w: WindowSpec, times: int = 1) -> Column:
    """The value k*times rows earlier (by position, not by frame number)."""
    return by_value(k, values, lambda v: F.lag(c, v * times).over(w))


def trailing(agg: Callable[[Column], Column], c: Column, k: Column, values: Sequence[int], w: WindowSpec, times: int = 1) -> Column:
    """Aggregate over the last k*times rows, the current one included."""
    return by_value(k, values, lambda v: agg(c).over(w.rowsBetween(-(v * times - 1), 0)))


def centred(agg: Callable[[Column], Column], c: Column, half: Column, values: Sequence[int], w: WindowSpec) -> Column:
    return by_value(half, values, lambda v: agg(c).over(w.rowsBetween(-v, v)))


def full_centred_mean(c: Column, half: Column, values: Sequence[int], w: WindowSpec) -> Column:
    """Mean over rows -half..half where all of them exist and hold a value, else NULL."""

    def one(v: int) -> Column:
        width = 2 * v + 1
        if v <= DIRECT_ROWS:
            frame = w.rowsBetween(-v, v)
            return F.when(F.count(c).over(frame) == width, F.avg(c).over(frame))
        upto = w.rowsBetween(Window.unboundedPreceding, v)
        before = w.rowsBetween(Window.unboundedPreceding, -v - 1)
        count = F.count(c).over(upto) - F.count(c).over(before)
        total = F.sum(c.cast("double")).over(upto) - F.coalesce(F.sum(c.cast("double")).over(before), F.lit(0.0))
        return F.when(count == width, total / width)

    return by_value(half, values, one)


def run_number(starts: Column, w: WindowSpec) -> Column:
    """Number of the run a row belongs to, given where runs start."""
    return F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
