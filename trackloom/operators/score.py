"""Interval scoring: validation, overlap, F-beta per laboratory and action, macro means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fbeta

KEY = ["video_id", "agent_id", "target_id", "action"]
SUBMISSION = [*KEY, "start_frame", "stop_frame"]
SOLUTION = [*SUBMISSION, "behaviors_labeled", "lab_id"]
#: Frames of one bin of the interval join.
BIN = 1024


class HostVisibleError(Exception):
    """A table that cannot be scored."""


def overlap_flags(intervals: DataFrame) -> DataFrame:
    """``overlaps``: the interval starts before an earlier one of its pair, of whatever action, has stopped."""
    w = Window.partitionBy("video_id", "agent_id", "target_id").orderBy("start_frame", "stop_frame", "action").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("overlaps", F.coalesce(F.max("stop_frame").over(w) > F.col("start_frame"), F.lit(False)))


def validation_report(solution: DataFrame, submission: DataFrame) -> DataFrame:
    """One row of counts; all but the first two must be zero and those two must not."""

    def of(df: DataFrame, columns: list[str], tag: str) -> DataFrame:
        missing = [F.col(c).isNull() for c in columns]
        any_missing = missing[0]
        for m in missing[1:]:
            any_missing = any_missing | m
        return overlap_flags(df).agg(
            F.count(F.lit(1)).alias(f"{tag}_rows"),
            F.count_if(any_missing).alias(f"{tag}_missing"),
            F.count_if(F.col("start_frame") >= F.col("stop_frame")).alias(f"{tag}_empty"),
            F.count_if("overlaps").alias(f"{tag}_overlaps"),
        )

    unknown = submission.select("video_id").distinct().join(solution, "video_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_videos"))
    texts = solution.groupBy("video_id").agg((F.count_distinct("behaviors_labeled") + F.max(F.col("behaviors_labeled").isNull().cast("int"))).alias("n"))
    uneven = texts.agg(F.count_if(F.col("n") > 1).alias("inconsistent_videos"))
    # one row each: the joins below put four single rows side by side
    parts = [of(solution, SOLUTION, "solution"), of(submission, SUBMISSION, "submission"), unknown, uneven]
    out = parts[0].withColumn("__one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def validate_for_scoring(solution: DataFrame, submission: DataFrame) -> None:
    """Raises on tables that cannot be scored, naming the columns or the number of rows at fault."""
    tables = (("solution", solution, SOLUTION), ("submission", submission, SUBMISSION))
    for name, df, columns in tables:
        if lacking := [c for c in columns if c not in df.columns]:
            raise HostVisibleError(f"{name}: no column {', '.join(lacking)}")
    r = validation_report(solution, submission).first()
    for name, _, columns in tables:
        if not r[f"{name}_rows"]:
            raise HostVisibleError(f"{name}: no rows to score")
        faults = {"missing": f"rows with a NULL among {', '.join(columns)}", "empty": "intervals that stop before they cover a frame", "overlaps": "intervals that overlap another of their pair"}
        for fault, text in faults.items():
            if n := r[f"{name}_{fault}"]:
                raise HostVisibleError(f"{name}: {n} {text}")
    if n := r["unknown_videos"]:
        raise HostVisibleError(f"submission: {n} recordings that the solution lacks")
    if n := r["inconsistent_videos"]:
        raise HostVisibleError(f"solution: {n} recordings with more than one list in behaviors_labeled")


def _binned(rows: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Intervals cut at multiples of ``BIN`` frames, so that only neighbours in time meet in a join."""
    cut = rows.where("start_frame < stop_frame")
    first, last = (F.floor(c / BIN).cast("int") for c in (F.col("start_frame"), F.col("stop_frame") - 1))
    cut = cut.select(*keys, "start_frame", "stop_frame", F.explode(F.sequence(first, last)).alias("bin"))
    return cut.select(*keys, "bin", F.greatest("start_frame", F.col("bin") * BIN).alias(start), F.least("stop_frame", (F.col("bin") + 1) * BIN).alias(stop))


def _shared(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], name: str, extra: list[str] | None = None) -> DataFrame:
    """Frames that intervals of ``a`` and ``b`` (which also has the columns ``extra``) of one key share, summed by ``by``."""
    left, right = _binned(a, keys, "s1", "e1"), _binned(b, [*(extra or []), *keys], "s2", "e2")
    met = left.join(right, [*keys, "bin"]).where("s1 < e2 and s2 < e1")
    return met.groupBy(*by).agg(F.sum(F.least("e1", "e2") - F.greatest("s1", "s2")).cast("long").alias(name))


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str], name: str = "overlap") -> DataFrame:
    """Frames shared by the disjoint intervals of ``a`` and ``b``, summed by key."""
    return _shared(a, b, keys, keys, name)


def active_labels(solution: DataFrame) -> DataFrame:
    """(video_id, agent_id, target_id, action) that a video's JSON list names."""
    first = solution.groupBy("video_id").agg(F.min("behaviors_labeled").alias("json"))
    triads = first.select("video_id", F.explode(F.array_distinct(F.from_json("json", "array<string>"))).alias("triad"))
    part = F.split("triad", ",")
    return triads.select("video_id", part[0].alias("agent_id"), part[1].alias("target_id"), part[2].alias("action"))


def fbeta_stats(solution: DataFrame, submission: DataFrame, beta: float = 1.0, extra: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and F-beta by laboratory and action of the solution.

    ``extra`` names submission columns (a threshold, say) that every statistic is split by; each of their
    values present in the submission is scored against the whole solution.
    """
    extra = extra or []
    labs = solution.select("video_id", "lab_id").distinct()
    sub = submission.drop("lab_id").join(active_labels(solution), KEY, "left_semi").join(labs, "video_id")
    keys = ["lab_id", *KEY]
    length = F.sum(F.col("stop_frame") - F.col("start_frame")).cast("long")
    group = ["lab_id", "action"]
    truth = solution.groupBy(*group).agg(length.alias("truth"))
    said = sub.groupBy(*extra, *group).agg(length.alias("said"))
    hit = _shared(solution, sub, keys, [*extra, *group], "tp", extra)
    if extra:
        # an action of a laboratory counts at each value that left an interval in that laboratory
        values = sub.select(*extra, "lab_id").distinct()
        truth = values.join(truth, "lab_id")
    tp, all_said = F.coalesce("tp", F.lit(0)).cast("long"), F.coalesce("said", F.lit(0)).cast("long")
    out = truth.join(said, [*extra, *group], "left").join(hit, [*extra, *group], "left")
    out = out.select(*extra, *group, tp.alias("tp"), (all_said - tp).alias("fp"), (F.col("truth") - tp).alias("fn"))
    return out.withColumn("f_beta", fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta))


def macro_scores(stats: DataFrame, extra: list[str] | None = None) -> dict[str, DataFrame]:
    """Means by laboratory, by action, and over laboratories."""
    extra = extra or []
    by_lab = stats.groupBy(*extra, "lab_id").agg(F.avg("f_beta").alias("f_beta"))
    return {
        "all_stats": stats,
        "by_lab": by_lab,
        "by_action": stats.groupBy(*extra, "action").agg(F.avg("f_beta").alias("f_beta")),
        "macro": by_lab.groupBy(*extra).agg(F.avg("f_beta").alias("macro_f_beta")) if extra else by_lab.agg(F.avg("f_beta").alias("macro_f_beta")),
    }


def fbeta_by_action(solution: DataFrame, submission: DataFrame, beta: float = 1.0, validate: bool = True) -> dict[str, DataFrame]:
    if validate:
        validate_for_scoring(solution, submission)
    return macro_scores(fbeta_stats(solution, submission, beta))
