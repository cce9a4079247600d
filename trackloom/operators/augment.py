"""Augmentation: labelled stretches, widened by one lag, copied with rotated, flipped, scaled and noisy coordinates.

Every draw is a hash of seed and key, so a lost task repeats the same draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import broadcast_if_small
from ..functions.windows import by_value, ordered
from .geometry import coordinate_columns
from .kinematics import lag_frames
from .spine import NOTHING, PAIR


def uniform(seed: int, tag: str, *keys: str) -> Column:
    """A number in (0, 1) drawn from the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, tag: str, *keys: str) -> Column:
    u, v = uniform(seed, f"{tag}/u", *keys), uniform(seed, f"{tag}/v", *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def dilate_labels(dt: DataFrame, meta: DataFrame, lag_sec: float, values: list[int] | None = None) -> DataFrame:
    """``near_label``: a labelled row lies at most one lag of rows away."""
    from ..functions.windows import distinct_values

    dim = lag_frames(meta, lag_sec).select("video_id", "kf")
    ks = values if values is not None else distinct_values(dim, "kf")
    w = ordered(PAIR, ["video_frame", "action"])
    labelled = (F.col("action") != NOTHING).cast("int")
    near = by_value(F.col("kf"), ks, lambda k: F.max(labelled).over(w.rowsBetween(-k, k)) == 1)
    return dt.join(broadcast_if_small(dim), "video_id", "left").withColumn("near_label", F.coalesce(near, F.lit(False)))


def augment_coordinates(dt: DataFrame, seed: int = 0, noise: float = 0.02) -> DataFrame:
    """One rotation in 35 degrees, flip (4 of 5) and scale in 0.9 to 1.1 per pair, noise per coordinate."""
    angle = (uniform(seed, "angle", *PAIR) * 2 - 1) * math.radians(35)
    flip = F.when(uniform(seed, "flip", *PAIR) < 0.8, -1.0).otherwise(1.0)
    scale = 0.9 + 0.2 * uniform(seed, "scale", *PAIR)
    out = {}
    for x in (c for c in coordinate_columns(dt.columns) if "_x_" in f"_{c}"):
        y = f"_{x}".replace("_x_", "_y_", 1)[1:]
        px, py = F.col(x) * flip, F.col(y)
        keys = [*PAIR, "video_frame"]
        out[x] = (px * F.cos(angle) - py * F.sin(angle)) * scale + noise * normal(seed, x, *keys)
        out[y] = (px * F.sin(angle) + py * F.cos(angle)) * scale + noise * normal(seed, y, *keys)
    return dt.withColumns(out)


def add_augmented_blocks(dt: DataFrame, meta: DataFrame, lag_sec: float, seed: int = 0, values: list[int] | None = None) -> DataFrame:
    """``dt`` and, marked ``aug``, a perturbed copy of the rows near labels."""
    near = dilate_labels(dt, meta, lag_sec, values).where("near_label").select(dt.columns)
    return dt.withColumn("aug", F.lit(False)).unionByName(augment_coordinates(near, seed).withColumn("aug", F.lit(True)))
