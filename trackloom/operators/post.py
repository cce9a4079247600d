"""From frame scores to intervals: smoothing, thresholds, per-frame argmax, gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import mouse_name
from ..functions.sizes import broadcast_if_small
from ..functions.windows import distinct_values, full_centred_mean, ordered, run_number

PAIR = ["video_id", "agent_id", "target_id"]
BACKGROUND = ("unlabeled", "Nothing")


def by_recording(preds: DataFrame) -> DataFrame:
    """One exchange by recording, which smoothing, argmax and islands all accept as it is."""
    return preds.repartition("video_id")


def smooth_scores(preds: DataFrame, roll_frames: int | float | DataFrame | None) -> DataFrame:
    """Centred rolling mean per pair and action, by position; rows without a full window keep their score.

    ``roll_frames``: frames, or a table (lab_id, action, roll_frames); even widths grow by one.
    """
    if roll_frames is None:
        return preds
    if isinstance(roll_frames, (int, float)):
        half, values, rows = F.lit(int(roll_frames) // 2), [int(roll_frames) // 2], preds
    else:
        dim = roll_frames.select("lab_id", "action", F.floor(F.col("roll_frames") / 2).cast("int").alias("__half"))
        values = distinct_values(dim, "__half")
        half, rows = F.col("__half"), preds.join(broadcast_if_small(dim), ["lab_id", "action"], "left")
    mean = full_centred_mean(F.col("score"), half, values, ordered([*PAIR, "action"], ["video_frame"]))
    score = F.coalesce(mean.cast("float"), F.col("score")) if values else F.col("score")
    return rows.withColumn("score", score).select(preds.columns)


def above_threshold(preds: DataFrame, threshold: float | DataFrame | None) -> DataFrame:
    """Rows whose score is strictly above the threshold; a missing threshold drops the row."""
    if threshold is None:
        return preds
    if isinstance(threshold, (int, float)):
        return preds.where(F.col("score") > F.lit(float(threshold)).cast("float"))
    keys = [c for c in ("lab_id", "action") if c in threshold.columns]
    return preds.join(broadcast_if_small(threshold.select(*keys, "z_thr")), keys, "left").where("score > z_thr").select(preds.columns)


def argmax_frames(preds: DataFrame, threshold: float | DataFrame | None = None) -> DataFrame:
    """The best action of each pair and frame; ties go to the first action in binary order."""
    w = ordered([*PAIR, "video_frame"], [F.col("score").desc(), F.col("action")])
    return above_threshold(preds, threshold).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def islands(rows: DataFrame, by: list[str], extra_break: Column | None = None) -> DataFrame:
    """``rows`` with ``run``: it changes where the action does or frames are not consecutive."""
    w = ordered(by, ["video_frame"])
    same = (F.lag("action").over(w) == F.col("action")) & (F.lag("video_frame").over(w) + 1 == F.col("video_frame"))
    if extra_break is not None:
        same = same & ~extra_break
    return rows.withColumn("run", run_number(~F.coalesce(same, F.lit(False)), w))


def get_intervals(frames: DataFrame, *, keep: list[str] | None = None, names: bool = True, min_frames: int = 2) -> DataFrame:
    """Half-open intervals of consecutive frames of one action, at least ``min_frames`` long."""
    keys = [*(keep or []), *PAIR]
    out = (
        islands(frames, keys)
        .groupBy(*keys, "run", "action")
        .agg(F.min("video_frame").alias("start_frame"), (F.max("video_frame") + 1).alias("stop_frame"))
        .where(F.col("stop_frame") - F.col("start_frame") >= min_frames)
    )
    ids = [mouse_name(F.col(c)).alias(c) if names and c in ("agent_id", "target_id") else F.col(c) for c in keys]
    return out.select(*ids, "action", "start_frame", "stop_frame")


def filter_by_whitelist(preds: DataFrame, whitelist: DataFrame | None) -> DataFrame:
    """Rows whose pair may show the action, and background rows."""
    if whitelist is None:
        return preds
    keys = [*PAIR, "action"]
    allowed = whitelist.select(*keys).distinct().withColumn("__allowed", F.lit(True))
    return preds.join(allowed, keys, "left").where(F.col("__allowed") | F.col("action").isin(*BACKGROUND)).select(preds.columns)


def melt_scores(wide: DataFrame, ids: list[str], actions: list[str]) -> DataFrame:
    return wide.unpivot(ids, sorted(actions), "action", "score").where("score is not null")
