"""Row-wise geometry of body-part coordinates; missing parts are skipped."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hypot, row_mean, safe_max
from ..functions.sizes import broadcast_if_small

# Parts of the body halves.
UPPER = (
    "nose", "head", "ear_left", "ear_right", "neck", "headpiece_bottombackleft", "headpiece_bottombackright",
    "headpiece_bottomfrontleft", "headpiece_bottomfrontright", "headpiece_topbackleft", "headpiece_topbackright",
    "headpiece_topfrontleft", "headpiece_topfrontright",
)
LOWER = ("tail_base", "hip_left", "hip_right")
OTHER = ("body_center", "lateral_left", "lateral_right", "spine_1", "spine_2")

_AXIS = re.compile(r"(?:^|_)[xy](?:_|$)")


def coordinate_columns(columns: Sequence[str]) -> list[str]:
    """Columns with x or y as a whole token of their name."""
    return [c for c in columns if _AXIS.search(c)]


def normalize_xy(dt: DataFrame, meta: DataFrame) -> DataFrame:
    """Pixels to centimetres by each recording's scale."""
    scale = meta.select("video_id", F.col("pix_per_cm_approx").cast("double").alias("__scale"))
    out = dt.join(broadcast_if_small(scale), "video_id", "left")
    return out.withColumns({c: F.try_divide(F.col(c).cast("double"), F.col("__scale")) for c in coordinate_columns(dt.columns)}).select(dt.columns)


def body_geometry(dt: DataFrame, role: str) -> DataFrame:
    """Adds centre, upper and lower means, body length and unit vector of ``ag`` or ``tg``."""
    prefix = f"{role}_" if role else ""
    there = set(dt.columns)

    def mean(axis: str, parts: Sequence[str]) -> Column:
        return row_mean([F.col(n) for p in parts if (n := f"{prefix}{axis}_{p}") in there])

    means = {f"{prefix}{axis}_{name}": mean(axis, parts) for name, parts in (("center", [*UPPER, *LOWER, *OTHER]), ("upper", UPPER), ("lower", LOWER)) for axis in ("x", "y")}
    dx, dy = (F.col(f"{prefix}{a}_upper") - F.col(f"{prefix}{a}_lower") for a in ("x", "y"))
    length = F.col(f"{prefix}body_len")
    return (
        dt.withColumns(means)
        .withColumn(f"{prefix}body_len", safe_max(hypot(dx, dy), 1e-6))
        .withColumns({f"{prefix}unit_x": dx / length, f"{prefix}unit_y": dy / length})
    )


def reference_length(norm_by: str | None, length: str, by: Sequence[str]) -> Column:
    if norm_by == "med_body_len":
        return safe_max(F.median(length).over(Window.partitionBy(*by)), 1e-9)
    return F.col(length) if norm_by == "frame_body_len" else F.lit(1.0)


def agent_frame(dx: Column, dy: Column, ux: Column, uy: Column) -> tuple[Column, Column]:
    """A vector turned so that the agent's unit vector points along x."""
    return dx * ux + dy * uy, dy * ux - dx * uy


def ear_gap(dt_columns: Sequence[str], ref: Column, prefix: str = "") -> Column:
    x = [f"{prefix}x_ear_left", f"{prefix}x_ear_right"]
    if not set(x) <= set(dt_columns):
        return F.lit(None).cast("double")
    wide = lambda n: F.col(n).cast("double")
    return hypot(wide(x[0]) - wide(x[1]), wide(f"{prefix}y_ear_left") - wide(f"{prefix}y_ear_right")) / ref


def pair_distances(dt: DataFrame, bodyparts: Sequence[str], ids: Sequence[str], bp_set: str = "raw") -> DataFrame:
    """Squared distances within the agent (m1m1), within the target (m2m2) and between them (m1m2).

    ``bp_set`` other than ``raw`` uses centre, lower and upper means instead of single parts.
    """
    if bp_set != "raw":
        dt = body_geometry(body_geometry(dt, "ag"), "tg")
        bodyparts = ["center", "lower", "upper"]
    there = set(dt.columns)
    has = {role: [p for p in bodyparts if {f"{role}_x_{p}", f"{role}_y_{p}"} <= there] for role in ("ag", "tg")}

    def squared(r1: str, a: str, r2: str, b: str, tag: str) -> Column:
        dx, dy = (F.col(f"{r1}_{axis}_{a}").cast("double") - F.col(f"{r2}_{axis}_{b}").cast("double") for axis in ("x", "y"))
        return (dx * dx + dy * dy).alias(f"{tag}+{a}+{b}")

    own = [squared(r, a, r, b, tag) for r, tag in (("ag", "m1m1"), ("tg", "m2m2")) for a, b in combinations(has[r], 2)]
    cross = [squared("ag", a, "tg", b, "m1m2") for a in has["ag"] for b in has["tg"]]
    return dt.select(*[F.col(f"`{i}`") for i in ids], *own, *cross)
