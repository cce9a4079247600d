"""Threshold search without multiplying rows by candidates.

A frame lies in an interval at threshold z if it and a neighbour (the frame before or after, of the same action) score above
z: its *level* is the lesser of its own score and its better neighbour's. Counting frames by level, from the highest down,
gives true and false positives of all candidates at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fbeta, mouse_name
from ..functions.sizes import broadcast_if_small
from ..functions.tables import materialise
from ..functions.windows import ordered
from .post import PAIR, argmax_frames, by_recording, filter_by_whitelist, get_intervals, smooth_scores
from .score import KEY, active_labels

#: Thresholds in log-odds from -11 to 20 by tenths.
DEFAULT_GRID = [k / 10 for k in range(-110, 201)]


def candidates(preds: DataFrame, z_grid: Sequence[float], by: list[str]) -> DataFrame:
    """(by, zs): ascending grid values between a group's least and greatest score, or the least score where none lies there."""
    bounds = preds.groupBy(*by).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    grid = F.array(*[F.lit(float(z)) for z in sorted(set(z_grid))]).cast("array<float>")
    fitting = F.filter(grid, lambda z: (z >= F.col("low")) & (z <= F.col("high")))
    return bounds.select(*by, F.when(F.size(fitting) > 0, fitting).otherwise(F.array("low")).alias("zs"))


def levels(frames: DataFrame, by: list[str]) -> DataFrame:
    """``frames`` that have a neighbour, with their ``level``. Rows of one action and pair, or one row a frame."""
    w = ordered([*by, *PAIR], ["video_frame"])

    def neighbour(look: Any, step: int) -> Column:
        close = (look("video_frame").over(w) == F.col("video_frame") + step) & (look("action").over(w) == F.col("action"))
        return F.when(close, look("score").over(w))

    near = F.greatest(neighbour(F.lag, -1), neighbour(F.lead, 1))
    return frames.withColumn("level", F.when(near.isNotNull(), F.least("score", near))).where("level is not null")


def _below(level: Column, rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``pos``: how many entries of the ascending array ``zs`` lie below the level; a binary search."""
    rows = rows.withColumn("pos", F.lit(0))
    for step in (1 << k for k in range(most.bit_length() - 1, -1, -1)):
        further = F.get("zs", F.col("pos") + step - 1) < level
        rows = rows.withColumn("pos", F.when(further, F.col("pos") + step).otherwise(F.col("pos")))
    return rows


def _tried(frames: DataFrame, z: DataFrame, solution: DataFrame, by: list[str], most: int) -> DataFrame:
    """(lab_id, action, z, f_beta) of every action of the solution at every candidate of its group.

    ``frames`` have levels. Counts are of frames: one counts as often as intervals of the truth cover it.
    """
    named = frames.withColumns({c: mouse_name(F.col(c)) for c in ("agent_id", "target_id")}).drop("lab_id")
    named = named.join(active_labels(solution), KEY, "left_semi").join(broadcast_if_small(solution.select("video_id", "lab_id").distinct()), "video_id")
    spans = solution.where("start_frame < stop_frame").select("lab_id", *KEY, F.explode(F.sequence("start_frame", F.col("stop_frame") - 1)).alias("video_frame"))
    keys = ["lab_id", *KEY, "video_frame"]
    met = named.select(*keys, "level").join(spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits")), keys, "left")
    placed = _below(F.col("level"), met.join(broadcast_if_small(z), by), most)
    counts = placed.groupBy("lab_id", "action", "pos").agg(F.count(F.lit(1)).alias("said"), F.coalesce(F.sum("hits"), F.lit(0)).alias("tp"))
    truth = solution.groupBy("lab_id", "action").agg(F.sum(F.col("stop_frame") - F.col("start_frame")).alias("truth"))
    wanted = truth.join(broadcast_if_small(z), by).select("lab_id", "action", "truth", F.posexplode("zs").alias("pos", "z"))
    none = F.lit(None)
    both = wanted.select("lab_id", "action", "pos", "truth", "z", F.lit(0).alias("counted"), F.lit(0).cast("long").alias("said"), F.lit(0).cast("long").alias("tp")).unionByName(
        counts.select("lab_id", "action", "pos", none.cast("long").alias("truth"), none.cast("float").alias("z"), F.lit(1).alias("counted"), "said", "tp")
    )
    # a candidate keeps the frames above it: those that more candidates lie below than stand before it
    down = Window.partitionBy("lab_id", "action").orderBy(F.col("pos").desc(), "counted").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumns({"said": F.sum("said").over(down), "tp": F.sum("tp").over(down)}).where("counted = 0")
    return summed.select("lab_id", "action", "z", fbeta(F.col("tp"), F.col("said") - F.col("tp"), F.col("truth") - F.col("tp")).alias("f_beta"))


def _best(tried: DataFrame, by: list[str]) -> DataFrame:
    """Best value and its lowest threshold; values equal to nine places tie."""
    w = Window.partitionBy(*by).orderBy(F.col("f").desc(), "z")
    return tried.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*by, F.col("z").alias("z_thr"), F.col("f").cast("float").alias("score"))


def tune_per_action(preds: DataFrame, solution: DataFrame, z_grid: Sequence[float] = DEFAULT_GRID) -> DataFrame:
    """Threshold of each laboratory and action by its F-beta; each action stands alone."""
    by = ["lab_id", "action"]
    tried = _tried(levels(preds, by), candidates(preds, z_grid, by), solution, by, len(z_grid))
    return _best(tried.withColumn("f", F.round("f_beta", 9)), by)


def tune_per_lab(preds: DataFrame, solution: DataFrame, z_grid: Sequence[float] = DEFAULT_GRID) -> DataFrame:
    """One threshold per laboratory by its mean F-beta over the solution's actions.

    The best action of a frame does not depend on the threshold as long as it survives, so the argmax is taken once.
    """
    best = argmax_frames(preds)
    tried = _tried(levels(best, ["lab_id"]), candidates(preds, z_grid, ["lab_id"]), solution, ["lab_id"], len(z_grid))
    return _best(tried.groupBy("lab_id", "z").agg(F.round(F.avg("f_beta"), 9).alias("f")), ["lab_id"])


def _fit(smooth: DataFrame, solution: DataFrame, z_grid: Sequence[float], per_lab: bool) -> DataFrame:
    known = smooth.join(broadcast_if_small(solution.select("lab_id").distinct()), "lab_id", "left_semi")
    return (tune_per_lab if per_lab else tune_per_action)(known, solution, z_grid)


def fit_thresholds(preds: DataFrame, solution: DataFrame, roll_frames: Any, z_grid: Sequence[float] = DEFAULT_GRID, per_lab: bool = False, labs: Sequence | None = None) -> DataFrame:
    """Smooth, then tune. Laboratories without a solution are left out, unless ``labs`` names them: then that is an error."""
    if labs is not None:
        found = {r["lab_id"] for r in solution.select("lab_id").distinct().collect()}
        if lacking := sorted(set(labs) - found, key=str):
            raise KeyError(f"no solution for laboratories {lacking}")
    smooth = smooth_scores(by_recording(preds.withColumn("score", F.col("score").cast("float"))), roll_frames)
    return _fit(smooth, solution, z_grid, per_lab)


def prepare_submit(
    preds: DataFrame,
    whitelist: DataFrame | None,
    roll_frames: Any,
    solution: DataFrame | None = None,
    z_grid: Sequence[float] | None = None,
    thresholds: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(intervals, thresholds): whitelist, smoothing, thresholds if asked for, argmax, islands.

    Where thresholds are to be fitted, filtered and smoothed scores are written once, fitted on and applied to.
    """
    smooth = smooth_scores(by_recording(filter_by_whitelist(preds, whitelist)), roll_frames)
    if thresholds is None and z_grid is not None:
        smooth = materialise(smooth.withColumn("score", F.col("score").cast("float")), "smooth-scores")
        per_lab = not smooth.where("action = 'Nothing'").isEmpty()
        thresholds = materialise(_fit(smooth, solution, z_grid, per_lab).drop("score"), "thresholds")
        smooth = by_recording(smooth)
    return get_intervals(argmax_frames(smooth, thresholds)), thresholds


def window_grid(columns: Sequence[Sequence[str]]) -> list[dict]:
    """One configuration per set of window columns."""
    return [{"window_cols": list(c)} for c in columns]


def uniform_windows(lab: str, actions: Sequence[str], columns: Sequence[str]) -> dict:
    """A laboratory's feature configuration with the same window columns for all actions."""
    return {lab: {a: {"window_cols": list(columns)} for a in actions}}


def lag_grid(lags: Sequence[float]) -> list[dict]:
    return [{"lag_sec": x} for x in lags]


def sample_grid(negatives: Sequence[float], unlabelled: Sequence[float]) -> list[dict]:
    return [{"sample_neg_percent": n, "sample_unl_percent": u} for n, u in itertools.product(negatives, unlabelled)]


def tune_laboratories(configs: Mapping[str, Sequence[dict]], score, patience: int | None = None) -> list[dict]:
    """The best configuration of each laboratory by ``score(lab, config)``: a row each with value and number of trials."""
    report = []
    for lab, own in configs.items():
        best, trials = tune_configurations(own, lambda c, lab=lab: score(lab, c), patience)
        report.append({"lab_id": lab, "best": best, "score": max((v for _, v in trials), default=None), "trials": len(trials)})
    return report


def tune_configurations(configs: Sequence[dict], score, patience: int | None = None) -> tuple[dict | None, list[tuple[dict, float]]]:
    """Best configuration by ``score(config)``; stops after ``patience`` configurations without improvement."""
    best, trials, since = None, [], 0
    for config in configs:
        value = float(score(config))
        trials.append((config, value))
        if best is None or value > best[1]:
            best, since = (config, value), 0
        else:
            since += 1
            if patience is not None and since >= patience:
                break
    return (best[0] if best else None), trials


def random_search(space: dict[str, Sequence], score, trials: int = 24, seed: int = 42) -> tuple[dict | None, list[tuple[dict, float]]]:
    """Categorical search maximising ``score``, without repeats."""
    import numpy as np

    names = sorted(space)
    every = list(itertools.product(*(space[n] for n in names)))
    order = np.random.default_rng(seed).permutation(len(every))[:trials]
    return tune_configurations([dict(zip(names, every[i], strict=True)) for i in order], score)
