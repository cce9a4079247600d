"""Typed readers of metadata, annotations, tracks, pseudo-labels and configuration."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sizes import broadcast_if_small

META = "lab_id string, video_id string, frames_per_second float, pix_per_cm_approx float, body_parts_tracked string, behaviors_labeled string"
ANNOTATION = "agent_id int, target_id int, action string, start_frame int, stop_frame int"
TRACK = "video_frame int, mouse_id int, bodypart string, x float, y float"
PSEUDO = "video_id string, agent_id int, target_id int, video_frame int, action string"
#: Actions that annotations hold but nothing uses.
DROPPED_ACTIONS = ("ejaculate",)


def file_stem() -> Column:
    """Name of the file a row comes from, without its suffix: recordings are files."""
    # the name comes as part of a URL, in which a plus sign stands for itself
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns by name with declared types; a file may hold others."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata CSV; a missing list of behaviours is an empty one. Equal rows are one, different rows of a recording an error."""
    meta = _typed_csv(spark, path, META).withColumn("behaviors_labeled", F.coalesce("behaviors_labeled", F.lit("[]"))).distinct()
    rows = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    clash = F.raise_error(F.concat(F.lit("different metadata rows of recording "), F.coalesce("video_id", F.lit("NULL"))))
    return meta.withColumn("__n", rows).withColumn("video_id", F.when(F.col("__n") > 1, clash).otherwise(F.col("video_id"))).drop("__n")


def _require_files(rows: DataFrame, what: str) -> DataFrame:
    if not rows.inputFiles():
        raise FileNotFoundError(f"no parquet file of {what}")
    return rows


def read_annotations(spark: SparkSession, folder: str, meta: DataFrame) -> DataFrame:
    """Parquet annotations anywhere under ``folder`` with recording (file stem) and laboratory. Rows without an action stay."""
    rows = spark.read.schema(ANNOTATION).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    dropped = F.coalesce(F.col("action").isin(*DROPPED_ACTIONS), F.lit(False))
    rows = _require_files(rows, f"annotations under {folder}").select(file_stem().alias("video_id"), "*").where(~dropped)
    return rows.join(broadcast_if_small(meta.select("video_id", "lab_id")), "video_id", "left")


def read_tracks(spark: SparkSession, folder: str, lab: str, bodyparts: Sequence[str] | None = None, frames: DataFrame | None = None, videos: Sequence[str] | None = None) -> DataFrame:
    """One laboratory's long tracks, from files anywhere under its folder.

    ``videos`` prunes files by name; a listed recording without a file is left out. ``frames`` keeps (video_id, mouse_id,
    video_frame). That nothing is found is an error.
    """
    names = "*"
    if videos is not None:
        if not videos:
            raise ValueError("no recordings to read")
        names = "{" + ",".join(re.sub(r"([\\*?\[\]{},])", r"\\\1", str(v)) for v in sorted({str(v) for v in videos})) + "}"
    reader = spark.read.schema(TRACK).option("recursiveFileLookup", True).option("pathGlobFilter", f"{names}.parquet")
    rows = _require_files(reader.parquet(f"{folder}/{lab}"), f"tracks of {lab}")
    rows = rows.select(file_stem().alias("video_id"), "mouse_id", "video_frame", "bodypart", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y")])
    if bodyparts is not None:
        rows = rows.where(F.col("bodypart").isin(*bodyparts))
    if frames is not None:
        rows = rows.join(frames.select("video_id", "mouse_id", "video_frame").distinct(), ["video_id", "mouse_id", "video_frame"], "left_semi")
    return rows


def read_partitioned_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks rewritten by :func:`trackloom.sources.writers.write_tracks`: partition columns prune laboratories."""
    return spark.read.parquet(path)


def read_pseudo_labels(spark: SparkSession, path: str | None) -> DataFrame | None:
    return None if path is None else _typed_csv(spark, path, PSEUDO)


def read_yaml(path: str) -> dict[str, Any]:
    import yaml

    with open(path) as f:  # configuration of the driver program, not data
        return yaml.safe_load(f) or {}


def read_mapping(path: str) -> dict[str, Any]:
    found = read_yaml(path)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return found


def window_features(lab: str, config: dict[str, Any], num_windows: int = 3) -> dict[str, Any]:
    """Window columns of a laboratory and, by action, the features made of them."""
    if lab not in config:
        raise ValueError(f"no features configured for {lab}")
    actions = config[lab] or {}
    if not isinstance(actions, dict) or any(v is not None and not isinstance(v, dict) for v in actions.values()):
        raise ValueError(f"malformed feature configuration of {lab}")
    columns = {a: (v or {}).get("window_cols") or [] for a, v in actions.items()}
    names = {a: sorted({f"{c}_lagw{n}_mean" for c in own for n in range(1, num_windows + 1)}) for a, own in columns.items()}
    return {"window_cols": sorted({c for own in columns.values() for c in own}), "by_action": names}
