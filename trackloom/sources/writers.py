"""Sinks: partitioned scores, small tables, run logs with growing schemas, tuned parameters."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def write_scores(oof: DataFrame, path: str) -> None:
    """Out-of-fold scores by laboratory."""
    oof.write.mode("overwrite").partitionBy("lab_id").parquet(path)


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Long tracks by laboratory; within one, sorted by recording so that its row groups prune too."""
    tracks.repartition("lab_id", "video_id").sortWithinPartitions("lab_id", "video_id", "mouse_id", "video_frame").write.mode("overwrite").partitionBy("lab_id").parquet(path)


def write_small_csv(table: DataFrame, path: str) -> None:
    """A table with a row per laboratory or action, as one CSV file."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def flatten(value: Mapping[str, Any], prefix: str = "", sep: str = "_") -> dict[str, Any]:
    """Nested mapping to one level; lists become comma-joined text."""
    out: dict[str, Any] = {}
    for key, v in value.items():
        name = f"{prefix}{sep}{key}" if prefix else str(key)
        if isinstance(v, Mapping):
            out |= flatten(v, name, sep)
        else:
            out[name] = ",".join(map(str, v)) if isinstance(v, (list, tuple)) else v
    return out


def append_run_log(spark: SparkSession, path: str, lab: str, params: Mapping[str, Any], n_features: int, scores: Mapping[str, float]) -> None:
    """One row per run; columns that earlier rows lack are merged when read."""
    row = {"lab_id": lab, "n_features": n_features} | {k: v if v is None or isinstance(v, (int, float, bool)) else str(v) for k, v in flatten(params).items()} | {k: round(float(v), 4) for k, v in scores.items()}
    row = {k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in row.items() if v is not None}
    spark.createDataFrame([row]).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def append_trial(path: str, row: Mapping[str, Any]) -> None:
    """One trial of a search as a line of a CSV on the driver; a header only where the file is new."""
    import csv
    import os

    new = not os.path.exists(path)
    with open(path, "a", newline="") as f:
        out = csv.writer(f)
        if new:
            out.writerow(row)
        out.writerow(row.values())


def upsert_params(path: str, model: str, lab: str, params: Mapping[str, Any]) -> dict:
    """Merge best parameters below model and laboratory of a YAML file on the driver."""
    import os

    import yaml

    from .readers import read_yaml

    found = read_yaml(path) if os.path.exists(path) else {}
    found.setdefault(model, {})[lab] = dict(params)
    with open(path, "w") as f:
        yaml.safe_dump(found, f, sort_keys=True)
    return found
