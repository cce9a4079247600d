"""Intervals from a stream of per-frame decisions.

A run of consecutive frames of one pair and action is a session: with frame n at n seconds, frames
at most one second apart join. The watermark closes a run once later frames have passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["video_id", "agent_id", "target_id"]


def frame_time(frame: str = "video_frame"):
    return F.timestamp_seconds(F.col(frame))


def stream_intervals(frames: DataFrame, *, lateness: str = "10 seconds", min_frames: int = 2) -> DataFrame:
    """Half-open intervals of a (streaming or static) table of (video_id, agent_id, target_id, action, video_frame)."""
    timed = frames.withColumn("at", frame_time()).withWatermark("at", lateness)
    runs = timed.groupBy(F.session_window("at", "1 second"), *PAIR, "action").agg(F.min("video_frame").alias("start_frame"), (F.max("video_frame") + 1).alias("stop_frame"))
    return runs.where(F.col("stop_frame") - F.col("start_frame") >= min_frames).select(*PAIR, "action", "start_frame", "stop_frame")
