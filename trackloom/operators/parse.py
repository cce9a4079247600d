"""Dimensions from metadata: whitelists, shared body parts, action durations, the solution table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_even, mouse_name
from ..functions.sizes import broadcast_if_small


def _mouse_number(name: Column, row: Column) -> Column:
    return F.when(name.rlike("^mouse[0-9]+$"), F.regexp_extract(name, "([0-9]+)$", 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("malformed behaviour: "), row)).cast("int"))


def parse_whitelist(meta: DataFrame) -> DataFrame:
    """(lab_id, video_id, agent_id, target_id, action) from the JSON lists of ``mouseN,mouseM|self,action``."""
    raw = F.explode(F.array_distinct(F.from_json("behaviors_labeled", "array<string>")))
    rows = meta.select("lab_id", "video_id", raw.alias("raw")).withColumn("raw", F.replace("raw", F.lit("'"), F.lit(""))).where(F.trim("raw") != "")
    part = F.transform(F.split("raw", ","), lambda p: F.lower(F.trim(p)))
    rows = rows.withColumn("part", F.when(F.size(part) == 3, part).otherwise(F.raise_error(F.concat(F.lit("malformed behaviour: "), F.col("raw"))).cast("array<string>")))
    agent, raw = F.col("part")[0], F.col("raw")
    target = F.when(F.col("part")[1] == "self", agent).otherwise(F.col("part")[1])
    return rows.select("lab_id", "video_id", _mouse_number(agent, raw).alias("agent_id"), _mouse_number(target, raw).alias("target_id"), F.col("part")[2].alias("action")).distinct()


def shared_bodyparts(meta: DataFrame) -> DataFrame:
    """(lab_id, bodyparts): sorted body parts that all of a laboratory's recordings track."""
    part = F.explode(F.array_distinct(F.from_json("body_parts_tracked", "array<string>")))
    rows = meta.select("lab_id", "video_id", part.alias("bodypart")).distinct()
    videos = meta.groupBy("lab_id").agg(F.count_distinct("video_id").alias("videos"))
    each = rows.groupBy("lab_id", "bodypart").agg(F.count(F.lit(1)).alias("n"))
    return each.join(broadcast_if_small(videos), "lab_id").where("n = videos").groupBy("lab_id").agg(F.array_sort(F.collect_list("bodypart")).alias("bodyparts"))


def action_durations(annotations: DataFrame) -> DataFrame:
    """Median duration of each laboratory's actions, rounded half to even."""
    rows = annotations.where("lab_id is not null and action is not null")
    return rows.groupBy("lab_id", "action").agg(half_even(F.median(F.col("stop_frame") - F.col("start_frame"))).alias("roll_frames"))


def build_solution(annotations: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Annotations with mouse names and the JSON list of what was labelled in their recording."""
    triad = F.concat_ws(",", mouse_name(F.col("agent_id")), mouse_name(F.col("target_id")), F.col("action"))
    lists = whitelist.groupBy("video_id").agg(F.to_json(F.array_sort(F.collect_set(triad))).alias("behaviors_labeled"))
    out = annotations.join(lists, "video_id", "left")
    return out.select(
        "lab_id",
        "video_id",
        mouse_name(F.col("agent_id")).alias("agent_id"),
        mouse_name(F.col("target_id")).alias("target_id"),
        "action",
        "start_frame",
        "stop_frame",
        F.coalesce("behaviors_labeled", F.lit("[]")).alias("behaviors_labeled"),
    )
