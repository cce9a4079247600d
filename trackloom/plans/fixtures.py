"""The driver's tables bound to the engine's schemas, for Spark; :mod:`.oracle` has the same in DuckDB.

Scores: one per recording, pair, hour and event type. Tracks: eight body parts of two mice from the
embedding vectors, with missing frames and parts. Every event and every vector is read: truth and predictions
differ in the values of some events, and missing points are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse, post, spine

BODYPARTS = ["nose", "ear_left", "ear_right", "neck", "body_center", "hip_left", "hip_right", "tail_base"]
LAG_SEC = 0.1
TRUTH_Z, SUBMIT_Z = 40.0, 20.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str, halved: int | None = None) -> DataFrame:
    """Frame scores; events whose id leaves the remainder ``halved`` modulo 3 score half, so that truth and predictions differ."""
    e = table(spark, sf_dir, "events")
    value = F.col("value") if halved is None else F.when(F.col("event_id") % 3 == halved, F.col("value") / 2).otherwise(F.col("value"))
    keys = [
        (F.col("user_id") % 2).cast("int").alias("lab_id"),
        (F.col("user_id") % 10).cast("int").alias("video_id"),
        F.lit(1).alias("agent_id"),
        (1 + F.col("user_id") % 2).cast("int").alias("target_id"),
        F.col("event_type").alias("action"),
        F.expr("cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts) as int)").alias("video_frame"),
    ]
    return e.groupBy(*keys).agg(F.max(value).cast("float").alias("score"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, 1)


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on the scale of the default threshold grid."""
    return preds(spark, sf_dir).withColumn("score", ((F.col("score").cast("double") - 100) / 10).cast("float"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the truth's per-frame best action."""
    best = post.argmax_frames(scores(spark, sf_dir, 0), TRUTH_Z)
    return post.get_intervals(best, keep=["lab_id"], names=False)


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.get_intervals(post.argmax_frames(preds(spark, sf_dir), SUBMIT_Z))


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["lab_id", "video_id", "agent_id", "target_id", "action"]
    unseen = ((F.col("lab_id") == 0) & (F.col("action") == "error")) | ((F.col("lab_id") == 1) & (F.col("action") == "signup"))
    return preds(spark, sf_dir).select(*keys).distinct().where(~unseen)


def solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.build_solution(annotations(spark, sf_dir), whitelist(spark, sf_dir))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's points; those of some whole frames and some single parts are NULL."""
    no_frame = F.col("vec_id") % 37 == 5

    def point(m: int, i: int, part: str) -> Column:
        k = (m - 1) * 16 + 2 * i
        missing = no_frame | ((F.col("vec_id") + i * 7 + m) % 23 == 0)
        x, y = (F.when(~missing, F.col("embedding")[at]).alias(axis) for axis, at in (("x", k), ("y", k + 1)))
        return F.struct(F.lit(m).alias("mouse_id"), F.lit(part).alias("bodypart"), x, y)

    points = F.array(*[point(m, i, part) for m in (1, 2) for i, part in enumerate(BODYPARTS)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.inline(points))
    return rows.select(F.expr("cast(vec_id div 100 as int)").alias("video_id"), "mouse_id", (F.col("vec_id") % 100).cast("int").alias("video_frame"), "bodypart", "x", "y")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("video_id")
    videos = table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 100 as int)").alias("video_id")).distinct()
    parts = F.concat(F.lit('["nose","ear_left","ear_right",'), F.when(v % 3 == 0, "").otherwise('"neck",'), F.lit('"body_center","hip_left","hip_right","tail_base"]'))
    said = F.concat(F.lit('["mouse1,mouse2,chase"," mouse1, self ,Rear","mouse1,mouse2,chase"'), F.when(v % 2 == 0, ",\"'mouse2,mouse1,sniff'\"").otherwise(""), F.lit("]"))
    return videos.select(
        F.concat(F.lit("lab"), (v % 2).cast("string")).alias("lab_id"),
        "video_id",
        F.when(v % 2 == 0, 20).otherwise(30).cast("float").alias("frames_per_second"),
        (10 + v).cast("float").alias("pix_per_cm_approx"),
        parts.alias("body_parts_tracked"),
        said.alias("behaviors_labeled"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.tracks_wide(tracks(spark, sf_dir), BODYPARTS)


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled model rows of the pairs that the metadata names."""
    pairs = parse.parse_whitelist(meta(spark, sf_dir))
    labels = spine.expand_to_frames(annotations(spark, sf_dir).where("false"))
    return spine.pair_spine(wide(spark, sf_dir), labels, pairs).drop("action").withColumn("aug", F.lit(False))


def labelled_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked frames of whitelisted pairs with the annotations' labels."""
    labels = spine.expand_to_frames(annotations(spark, sf_dir))
    return spine.pair_spine(wide(spark, sf_dir), labels, whitelist(spark, sf_dir), coordinates=False)


def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored frame of ten recordings with the truth's best action, or ``Nothing`` where that scores low."""
    best = post.argmax_frames(scores(spark, sf_dir, 0))
    action = F.when(F.col("score") > TRUTH_Z, F.col("action")).otherwise(spine.NOTHING)
    return best.select(*spine.PAIR, "video_frame", action.alias("action"))
