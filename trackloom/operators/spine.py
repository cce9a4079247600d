"""Frames and pairs: labels expanded to frames, wide tracks, the (frame, agent, target) spine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["video_id", "agent_id", "target_id"]
NOTHING = "Nothing"


def expand_to_frames(annotations: DataFrame) -> DataFrame:
    """One row per frame of each half-open interval; empty and reversed intervals have none."""
    rows = annotations.where("start_frame < stop_frame")
    return rows.select(*PAIR, F.explode(F.sequence("start_frame", F.col("stop_frame") - 1)).alias("video_frame"), "action")


def tracks_wide(tracks: DataFrame, bodyparts: Sequence[str]) -> DataFrame:
    """One row per recording, mouse and frame with x_/y_ of the listed parts; frames without any coordinate vanish."""
    rows = tracks.where(F.col("x").isNotNull() | F.col("y").isNotNull())
    values = [F.max(F.when(F.col("bodypart") == p, F.col(axis))).alias(f"{axis}_{p}") for p in bodyparts for axis in ("x", "y")]
    return rows.groupBy("video_id", "mouse_id", "video_frame").agg(*values)


def pair_spine(wide: DataFrame, labels: DataFrame, whitelist: DataFrame, coordinates: bool = True) -> DataFrame:
    """All tracked frames of each whitelisted pair, its label (or ``Nothing``) and both mice's coordinates.

    A whitelisted pair of an untracked recording keeps one row without frame; frames with several labels
    have a row for each.
    """
    frames = wide.select("video_id", "video_frame").distinct()
    pairs = whitelist.select(*PAIR).distinct()
    keys = [*PAIR, "video_frame"]
    spine = pairs.join(frames, "video_id", "left")
    out = spine.join(labels.select(*keys, "action"), keys, "left").withColumn("action", F.coalesce("action", F.lit(NOTHING)))
    if not coordinates:
        return out.select(*keys, "action")
    parts = [c for c in wide.columns if c[:2] in ("x_", "y_")]
    for role, name in (("ag", "agent_id"), ("tg", "target_id")):
        own = wide.select("video_id", F.col("mouse_id").alias(name), "video_frame", *[F.col(c).alias(f"{role}_{c}") for c in parts])
        out = out.join(own, ["video_id", name, "video_frame"], "left")
    return out.select(*keys, "action", *[f"{role}_{c}" for role in ("ag", "tg") for c in parts])


def fill_missing(dt: DataFrame, mode: str | None) -> DataFrame:
    if mode in (None, "none"):
        return dt
    if mode == "zeros":
        return dt.fillna(0)
    raise ValueError(f"unknown fill mode: {mode}")


def fill_both_ways(dt: DataFrame, columns: Sequence[str], by: Sequence[str] = PAIR) -> DataFrame:
    """Last known value, else the next known one, else 0, within each pair's frames."""
    w = Window.partitionBy(*by).orderBy("video_frame")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead), F.lit(0)) for c in columns}
    return dt.withColumns(filled)


def class_counts(spine: DataFrame, by: Sequence[str] = ("video_id",)) -> DataFrame:
    return spine.groupBy(*by, "action").agg(F.count(F.lit(1)).alias("n_rows"))


def encode_classes(rows: DataFrame) -> DataFrame:
    """(action, class_id): actions numbered in binary order. The vocabulary is small: one row per action."""
    return rows.select("action").distinct().withColumn("class_id", F.row_number().over(Window.orderBy("action")) - 1)
