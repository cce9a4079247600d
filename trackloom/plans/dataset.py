"""The model table: one lazy plan from tracks and labels to features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialise
from ..functions.windows import distinct_values
from ..operators import augment, geometry, kinematics, spine
from ..operators.score import fbeta_by_action
from ..operators.tune import prepare_submit


@dataclass
class FeatureParams:
    bodyparts: Sequence[str]
    lag_sec: float
    norm_by: str | None = "med_body_len"
    fill: str = "none"
    bp_set: str = "raw"
    window_cols: Sequence[str] = ()
    num_windows: int = 3
    augment: bool = False
    seed: int = 0


def build_dataset(tracks: DataFrame, labels: DataFrame, meta: DataFrame, whitelist: DataFrame, p: FeatureParams) -> DataFrame:
    """Keys, ``aug``, ``action`` and all features as floats; raw coordinates are dropped.

    ``tracks`` are in pixels, ``labels`` are frames (see :func:`spine.expand_to_frames`).
    """
    # each of the three tables below is read several times, so each is written once
    wide = materialise(geometry.normalize_xy(spine.tracks_wide(tracks, p.bodyparts), meta), "wide-tracks")
    dt = spine.fill_missing(spine.pair_spine(wide, labels, whitelist), p.fill)
    ks = distinct_values(kinematics.lag_frames(meta, p.lag_sec), "kf")
    dt = augment.add_augmented_blocks(dt, meta, p.lag_sec, p.seed, ks) if p.augment else dt.withColumn("aug", F.lit(False))
    dt = materialise(dt, "pair-rows")
    keys = [*kinematics.PAIR_TRACK, "video_frame", "action"]
    options = {"lag_sec": p.lag_sec, "norm_by": p.norm_by, "values": ks}
    # distances ride along the invariants' lineage; only the mice's own tracks come back by joins
    apart = geometry.pair_distances(dt, p.bodyparts, dt.columns, p.bp_set)
    distances = [c for c in apart.columns if c not in dt.columns]
    own = materialise(kinematics.mouse_kinematics(kinematics.mouse_tracks(dt), meta, **options), "mouse-features")
    out = kinematics.join_mouse_features(kinematics.pair_invariants(apart, meta, **options, carry=distances), own)
    if p.window_cols:
        out = kinematics.lag_window_stats(out, meta, p.window_cols, lag_sec=p.lag_sec, num_windows=p.num_windows, values=ks)
    out = out.where(~F.col("aug") | (F.col("action") != spine.NOTHING))
    return out.select(*keys, *[F.col(f"`{c}`").cast("float").alias(c) for c in out.columns if c not in keys])


def evaluate(oof: DataFrame, solution: DataFrame, whitelist: DataFrame, durations: DataFrame, z_grid: Sequence[float], validate: bool = False) -> dict:
    """Scores of the plain per-frame argmax and of the smoothed, thresholded intervals, with the thresholds."""
    from ..operators.post import argmax_frames, get_intervals

    raw = fbeta_by_action(solution, get_intervals(argmax_frames(oof)), validate=validate)
    submit, thresholds = prepare_submit(oof, whitelist, durations, solution, z_grid)
    post = fbeta_by_action(solution, submit, validate=validate)
    return {"raw": raw, "postproc": post, "z_by_lab": thresholds, "submit": submit}
