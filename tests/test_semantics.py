"""Hand-computed cases of the rules on missing values, rounding, ties and windows."""

import math

import pytest
from pyspark.sql import functions as F

from trackloom.functions import exprs
from trackloom.operators import augment, calibrate, kinematics, parse, post, sampling, score, spine, tune

PREDS = "lab_id int, video_id int, agent_id int, target_id int, action string, video_frame int, score float"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def preds(spark, rows):
    return spark.createDataFrame([(0, 1, 1, 2, a, f, float(s)) for a, f, s in rows], PREDS)


def spans(df):
    return sorted((r["action"], r["start_frame"], r["stop_frame"]) for r in df.collect())


def test_missing_values(spark):
    null = F.lit(None).cast("double")
    assert one(spark, exprs.row_mean([F.lit(1.0), null, F.lit(3.0)])) == 2
    assert one(spark, exprs.row_mean([])) is None
    assert one(spark, exprs.safe_max(null, 1e-12)) is None and one(spark, exprs.safe_max(F.lit(0.0), 1e-6)) == 1e-6
    assert one(spark, exprs.nan_to_null(F.lit(math.nan))) is None
    assert one(spark, exprs.fbeta(F.lit(0), F.lit(0), F.lit(0))) == 0.0


@pytest.mark.parametrize(("fps", "lag", "kf"), [(25, 0.1, 2), (20, 0.1, 2), (30, 0.1, 3), (1, 0.1, 1), (35, 0.1, 4)])
def test_lags_round_half_to_even(spark, fps, lag, kf):
    meta = spark.createDataFrame([(1, float(fps))], "video_id int, frames_per_second float")
    assert kinematics.lag_frames(meta, lag).first()["kf"] == kf


def test_lag_is_positional_with_a_gap_mask(spark):
    meta = spark.createDataFrame([(1, 20.0)], "video_id int, frames_per_second float")
    rows = spark.createDataFrame([(1, f) for f in (0, 1, 2, 4, 5, 6, 7, 8)], "video_id int, video_frame int")
    got = kinematics.add_lag_structure(rows, meta, 0.1, ["video_id"]).collect()
    assert [r["video_frame"] for r in got if r["ok1"]] == [2, 6, 7, 8]
    assert [r["video_frame"] for r in got if r["ok2"]] == [8]


def test_islands(spark):
    assert spans(post.get_intervals(preds(spark, [("a", f, 1) for f in (1, 2, 3, 5)]))) == [("a", 1, 4)]
    assert spans(post.get_intervals(preds(spark, [("a", 1, 1), ("a", 2, 1), ("b", 3, 1), ("b", 4, 1)]))) == [("a", 1, 3), ("b", 3, 5)]


def test_threshold_is_strict_and_ties_go_to_the_first_action(spark):
    rows = preds(spark, [("b", 0, 0.7), ("a", 0, 0.7), ("a", 1, 0.5)])
    assert [(r["action"], r["video_frame"]) for r in post.argmax_frames(rows, 0.5).collect()] == [("a", 0)]
    partial = spark.createDataFrame([(0, "a", 0.0)], "lab_id int, action string, z_thr float")
    assert {r["action"] for r in post.above_threshold(rows, partial).collect()} == {"a"}


@pytest.mark.parametrize("width", [3, 2])
def test_smoothing_needs_a_full_window(spark, width):
    got = {r["video_frame"]: r["score"] for r in post.smooth_scores(preds(spark, [("a", f, s) for f, s in enumerate([1, 2, 6, 4])]), width).collect()}
    assert got == {0: 1, 1: 3, 2: 4, 3: 4}


def test_long_windows_from_running_sums_agree(spark):
    rows = preds(spark, [("a", f, (f * 37) % 101) for f in range(400)])
    got = {r["video_frame"]: r["score"] for r in post.smooth_scores(rows, 151).collect()}
    for f in (0, 74, 75, 200, 324, 325, 399):
        want = sum((g * 37) % 101 for g in range(f - 75, f + 76)) / 151 if 75 <= f <= 324 else (f * 37) % 101
        assert got[f] == pytest.approx(want, rel=1e-5)


def test_empty_intervals_have_no_frames(spark):
    rows = spark.createDataFrame([(1, 1, 2, "a", 5, 5), (1, 1, 2, "a", 7, 5), (1, 1, 2, "a", 1, 3)], "video_id int, agent_id int, target_id int, action string, start_frame int, stop_frame int")
    assert sorted(r["video_frame"] for r in spine.expand_to_frames(rows).collect()) == [1, 2]


def test_frames_without_coordinates_vanish(spark):
    rows = spark.createDataFrame([(1, 1, 0, "nose", None, None), (1, 1, 1, "nose", 1.0, None)], "video_id int, mouse_id int, video_frame int, bodypart string, x float, y float")
    assert [r["video_frame"] for r in spine.tracks_wide(rows, ["nose"]).collect()] == [1]


def solution(spark, rows):
    full = [("l", v, a, t, act, s, e, '["mouse1,mouse2,a","mouse1,mouse2,b"]') for v, a, t, act, s, e in rows]
    return spark.createDataFrame(full, "lab_id string, video_id int, agent_id string, target_id string, action string, start_frame int, stop_frame int, behaviors_labeled string")


def test_overlap_scoring(spark):
    truth = solution(spark, [(1, "mouse1", "mouse2", "a", 0, 10)])
    said = solution(spark, [(1, "mouse1", "mouse2", "a", 2, 4), (1, "mouse1", "mouse2", "a", 8, 12), (1, "mouse1", "mouse2", "c", 0, 5)]).drop("lab_id", "behaviors_labeled")
    r = score.fbeta_stats(truth, said).first()
    assert (r["tp"], r["fn"], r["fp"]) == (4, 6, 2) and r["f_beta"] == pytest.approx(0.5)


def test_overlap_across_bins(spark):
    """Long and short disjoint intervals against a count of frames."""
    import random

    rng = random.Random(6)

    def spread(n, longest):
        at, out = rng.randrange(50), []
        for _ in range(n):
            stop = at + rng.randrange(1, longest)
            out.append((at, stop))
            at = stop + rng.randrange(300)
        return out

    sides = [{k: spread(n, longest) for k, (n, longest) in (("a", (40, 400)), ("b", (3, 5000)))} for _ in range(2)]
    one, two = (spark.createDataFrame([(k, s, e) for k, v in side.items() for s, e in v], "k string, start_frame int, stop_frame int") for side in sides)
    frames = [{k: {f for s, e in v for f in range(s, e)} for k, v in side.items()} for side in sides]
    got = {r["k"]: r["overlap"] for r in score.interval_overlap(one, two, ["k"]).collect()}
    assert got == {k: len(frames[0][k] & frames[1][k]) for k in "ab"}


def test_validation_messages(spark):
    truth = solution(spark, [(1, "mouse1", "mouse2", "a", 0, 10)])
    good = truth.drop("lab_id", "behaviors_labeled")
    score.validate_for_scoring(truth, good)
    cases = [
        (truth, good.limit(0), "submission: no rows"),
        (truth, good.drop("action"), "submission: no column action"),
        (truth, good.withColumn("action", F.lit(None).cast("string")), "submission: 1 rows with a NULL"),
        (truth, good.withColumn("stop_frame", F.lit(0)), "submission: 1 intervals that stop"),
        (truth, good.withColumn("video_id", F.lit(9)), "1 recordings that the solution lacks"),
        (truth, good.unionByName(good), "submission: 1 intervals that overlap"),
        (truth.unionByName(truth.withColumns({"behaviors_labeled": F.lit("[]"), "start_frame": F.lit(20), "stop_frame": F.lit(30)})), good, "1 recordings with more than one list"),
    ]
    for sol, sub, message in cases:
        with pytest.raises(score.HostVisibleError, match=message):
            score.validate_for_scoring(sol, sub)


def test_whitelist_rejects_malformed_entries(spark):
    meta = spark.createDataFrame([("l", 1, '["mouse1,mouse2"]')], "lab_id string, video_id int, behaviors_labeled string")
    with pytest.raises(Exception, match="malformed"):
        parse.parse_whitelist(meta).collect()


def test_durations_drop_null_labs(spark):
    rows = spark.createDataFrame([("l", "a", 0, 2), ("l", "a", 0, 3), (None, "a", 0, 9)], "lab_id string, action string, start_frame int, stop_frame int")
    assert [tuple(r) for r in parse.action_durations(rows).collect()] == [("l", "a", 2)]


def test_thresholds_prefer_the_lowest_of_equals(spark):
    p = spark.createDataFrame([("l", 1, 1, 2, "a", f, 5.0 if f < 4 else 1.0) for f in range(8)], PREDS.replace("lab_id int", "lab_id string"))
    truth = solution(spark, [(1, "mouse1", "mouse2", "a", 0, 4)])
    for tuned in (tune.tune_per_action(p, truth, [0, 1, 2, 3]), tune.tune_per_lab(p, truth, [0, 1, 2, 3])):
        r = tuned.first()
        assert (r["z_thr"], r["score"]) == (1.0, 1.0)


def spine_rows(spark, n=30):
    rows = [(v, 1, 2, f, "a" if f % 5 == v % 5 else "Nothing") for v in range(4) for f in range(n)]
    return spark.createDataFrame(rows, "video_id int, agent_id int, target_id int, video_frame int, action string")


def test_samples_keep_exact_shares(spark):
    rows = spine_rows(spark)
    by_video = {r["video_id"]: r["count"] for r in sampling.sample_by_video(rows, 25, 1).groupBy("video_id").count().collect()}
    assert by_video == dict.fromkeys(range(4), 7)
    kept = sampling.sample_unlabelled(rows, 0, 1)
    assert kept.where("action = 'Nothing'").count() == 4 and kept.where("action = 'a'").count() == 24


def test_run_weights_sum_to_the_positives(spark):
    got = sampling.run_weights(spine_rows(spark), "a").collect()
    assert sum(r["weight"] for r in got if r["action"] == "a") == pytest.approx(24)
    assert {r["weight"] for r in got if r["action"] != "a"} == {1.0}


def test_folds_cover_videos_and_hold_a_positive(spark):
    videos, good = [f"v{i}" for i in range(17)], {"v1", "v2", "v9", "v16"}
    rows = spark.createDataFrame([(v, "a" if v in good else "Nothing") for v in videos], "video_id string, action string")
    deals = set()
    for seed in range(4):
        table = sampling.make_folds(rows, "a", 4, seed).collect()
        folds = {f: {r["video_id"] for r in table if r["fold"] == f and r["role"] == "val"} for f in range(4)}
        assert sorted(v for f in folds.values() for v in f) == sorted(videos) and len(table) == 4 * 17
        assert all(f & good for f in folds.values())
        deals.add(str(sorted(map(sorted, folds.values()))))
    assert len(deals) > 1
    six = sampling.make_folds(rows, "a", 4, 1, num_models=6).where("role = 'val'").collect()
    assert {r["fold"] for r in six} == set(range(6)) and sum(r["fold"] < 4 for r in six) == 17
    few = rows.withColumn("action", F.when(F.col("video_id").isin("v1", "v2"), F.col("action")).otherwise("Nothing"))
    assert sampling.make_folds(few, "a", 5, 1).agg(F.max("fold")).first()[0] == 1


def test_thresholds_equal_a_search_by_intervals(spark):
    """Counting by levels against intervals made anew at every threshold."""
    import random

    rng = random.Random(2)
    rows = [("l", 1, 1, 2, a, f, float(rng.randrange(40)) / 4) for a in "ab" for f in range(120) if rng.random() < 0.85]
    p = spark.createDataFrame(rows, PREDS.replace("lab_id int", "lab_id string"))
    truth = solution(spark, [(1, "mouse1", "mouse2", a, s, s + 9) for a, start in (("a", 0), ("b", 15)) for s in range(start, 110, 30)])
    grid = [0.1 * k for k in range(-10, 110)]
    for tuned, by, frames in ((tune.tune_per_action(p, truth, grid), ["lab_id", "action"], p), (tune.tune_per_lab(p, truth, grid), ["lab_id"], post.argmax_frames(p))):
        for r in tuned.collect():
            own = frames.where(F.col("action") == r["action"]) if "action" in by else frames
            best = None
            for z in grid[10:-10:7] + [r["z_thr"]]:
                found = post.get_intervals(own.where(F.col("score") > F.lit(z).cast("float")))
                stats = score.fbeta_stats(truth, found)
                value = stats.where(F.col("action") == r["action"]).first()["f_beta"] if "action" in by else stats.agg(F.avg("f_beta")).first()[0]
                best = max(best or 0, value)
            assert value == pytest.approx(r["score"], abs=1e-6) and best <= r["score"] + 1e-6


def test_thresholds_name_missing_laboratories(spark):
    with pytest.raises(KeyError, match="no solution"):
        tune.fit_thresholds(preds(spark, [("a", 1, 1)]), solution(spark, [(1, "mouse1", "mouse2", "a", 0, 4)]), 3, labs=["l", "m"])


def test_platt(spark):
    rows = spark.createDataFrame([("a", float(x), int((x * 7) % 10 < 5 + x)) for x in range(-5, 6) for _ in range(3)] + [("b", 1.0, 1)], "action string, score double, y int")
    got = {r["action"]: r for r in calibrate.fit_platt(rows).collect()}
    assert (got["b"]["a"], got["b"]["b"], got["b"]["prior"]) == (1.0, 0.0, 1.0)
    a, b = got["a"]["a"], got["a"]["b"]
    grad = [sum((r["y"] - 1 / (1 + math.exp(-(a * r["score"] + b)))) * x for r in rows.where("action = 'a'").collect() for x in [1.0]) ]
    assert abs(grad[0]) < 1e-6
    same = one(spark, exprs.platt(F.lit(1.25), F.lit(1.0), F.lit(0.0), F.lit(0.5)))
    assert same == pytest.approx(1.25, abs=1e-5)


def test_platt_of_separable_and_far_scores(spark):
    """Plain Newton overshoots on the first group; the second has no finite optimum."""
    rows = [("far", x, y) for x, y in ((-30.0, 0), (-20.0, 1), (0.0, 0), (25.0, 1), (40.0, 1))] + [("apart", float(x), int(x > 0)) for x in (-2, -1, 1, 2)]
    frame = spark.createDataFrame(rows, "action string, score double, y int")
    got = {r["action"]: r for r in calibrate.fit_platt(frame).collect()}
    a, b = got["far"]["a"], got["far"]["b"]
    errors = [(y - 1 / (1 + math.exp(-(a * x + b))), x) for k, x, y in rows if k == "far"]
    assert abs(sum(e for e, _ in errors)) < 1e-6 and abs(sum(e * x for e, x in errors)) < 1e-5
    assert got["apart"]["a"] > 3 and math.isfinite(got["apart"]["a"])


def test_cross_fit_averages_repeated_folds_first(spark):
    """Two folds, one row in both: its mean margin is calibrated by its last fold's fit on the others."""
    rows = [(k, "a", 0.4 * k + f, int((k * 7) % 10 < 2 + k), f) for k in range(8) for f in ([0, 1] if k == 3 else [k % 2])]
    table = spark.createDataFrame(rows, "video_frame int, action string, score double, y int, fold int")
    got = {r["video_frame"]: r for r in calibrate.cross_fit(table, ["video_frame"]).collect()}
    assert len(got) == 8 and got[3]["score"] == pytest.approx(0.4 * 3 + 0.5) and got[3]["fold"] == 1
    means = calibrate.mean_margins(table, ["video_frame"])
    for f in (0, 1):
        own = calibrate.fit_platt(means.where(F.col("fold") != f)).first()
        for r in got.values():
            if r["fold"] == f:
                want = one(spark, exprs.platt(F.lit(r["score"]), F.lit(own["a"]), F.lit(own["b"]), F.lit(own["prior"])))
                assert r["calibrated"] == pytest.approx(want, abs=1e-5)
    with pytest.raises(ValueError, match="both classes"):
        calibrate.cross_fit(table.withColumn("y", F.lit(1)), ["video_frame"])


def test_dilation_clips_at_the_ends(spark):
    meta = spark.createDataFrame([(v, 20.0) for v in range(4)], "video_id int, frames_per_second float")
    rows = spark.createDataFrame([(1, 1, 2, f, "a" if f == 0 else "Nothing") for f in range(3)], "video_id int, agent_id int, target_id int, video_frame int, action string")
    assert [r["near_label"] for r in augment.dilate_labels(rows, meta, 0.05).orderBy("video_frame").collect()] == [True, True, False]


def test_augmentation_repeats_itself(spark):
    meta = spark.createDataFrame([(v, 20.0) for v in range(4)], "video_id int, frames_per_second float")
    rows = spine_rows(spark).withColumns({"ag_x_nose": F.col("video_frame") * 1.0, "ag_y_nose": F.lit(2.0)})
    a, b = (sorted(map(str, augment.add_augmented_blocks(rows, meta, 0.05, seed=1).repartition(n).collect())) for n in (1, 5))
    assert a == b
    assert augment.add_augmented_blocks(rows, meta, 0.05).where("aug").count() > 0


def test_grids_and_search():
    assert len(tune.sample_grid([1, 2], [3, 4, 5])) == 6 and tune.lag_grid([0.1])[0] == {"lag_sec": 0.1}
    best, trials = tune.tune_configurations(tune.lag_grid([0.1, 0.5, 0.2, 0.3]), lambda c: -abs(c["lag_sec"] - 0.45), patience=2)
    assert best == {"lag_sec": 0.5} and len(trials) == 4
    assert tune.uniform_windows("L", ["a", "b"], ["v"]) == {"L": {"a": {"window_cols": ["v"]}, "b": {"window_cols": ["v"]}}}
    report = tune.tune_laboratories({"L": tune.lag_grid([1, 2, 3]), "M": tune.lag_grid([5])}, lambda lab, c: c["lag_sec"] if lab == "M" else -c["lag_sec"], patience=1)
    assert report == [{"lab_id": "L", "best": {"lag_sec": 1}, "score": -1.0, "trials": 2}, {"lab_id": "M", "best": {"lag_sec": 5}, "score": 5.0, "trials": 1}]
    best, trials = tune.random_search({"a": [1, 2, 3], "b": [0, 1]}, lambda c: c["a"] + c["b"], trials=6)
    assert best == {"a": 3, "b": 1} and len(trials) == 6
