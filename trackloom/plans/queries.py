"""Registered queries: each operator applied to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import logit, sigmoid
from ..operators import augment, calibrate, geometry, kinematics, model, parse, post, sampling, score, spine, tune
from . import dataset
from . import fixtures as fx

FILL = ["x_nose", "y_tail_base"]
K4 = ["video_id", "agent_id", "target_id", "video_frame"]


def six(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places, so that engines that sum in another order agree."""
    pick = names or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.select(*[(F.round(F.col(f"`{c}`").cast("double"), 6) + 0.0).alias(c) if c in pick else F.col(f"`{c}`") for c in df.columns])


def intervals(s: SparkSession, d: str) -> DataFrame:
    return post.get_intervals(post.argmax_frames(post.smooth_scores(post.by_recording(fx.scores(s, d)), 3), 10.0))


def smooth_scores(s: SparkSession, d: str) -> DataFrame:
    return six(post.smooth_scores(fx.preds(s, d), parse.action_durations(fx.annotations(s, d))).withColumn("score", F.round("score", 3)))


def argmax_filter(s: SparkSession, d: str) -> DataFrame:
    return six(post.argmax_frames(fx.preds(s, d), fx.SUBMIT_Z))


def whitelist_filter(s: SparkSession, d: str) -> DataFrame:
    return six(post.filter_by_whitelist(fx.preds(s, d), fx.whitelist(s, d)))


def _wide_scores(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    actions = ["click", "error", "purchase", "signup", "view"]
    return fx.preds(s, d).groupBy(*K4).agg(*[F.max(F.when(F.col("action") == a, F.col("score"))).alias(a) for a in actions]), actions


def melt_scores(s: SparkSession, d: str) -> DataFrame:
    wide, actions = _wide_scores(s, d)
    return six(post.melt_scores(wide, K4, actions))


def whitelist_parse(s: SparkSession, d: str) -> DataFrame:
    return parse.parse_whitelist(fx.meta(s, d))


def bodypart_intersection(s: SparkSession, d: str) -> DataFrame:
    return parse.shared_bodyparts(fx.meta(s, d)).select("lab_id", F.array_join("bodyparts", ",").alias("bodyparts"))


def action_duration(s: SparkSession, d: str) -> DataFrame:
    return parse.action_durations(fx.annotations(s, d))


def expand_intervals(s: SparkSession, d: str) -> DataFrame:
    return spine.expand_to_frames(fx.annotations(s, d))


def tracks_wide(s: SparkSession, d: str) -> DataFrame:
    return six(fx.wide(s, d))


def pair_spine(s: SparkSession, d: str) -> DataFrame:
    labels = spine.expand_to_frames(fx.annotations(s, d))
    full = spine.pair_spine(fx.wide(s, d), labels, fx.whitelist(s, d))
    return six(full.select(*K4, "action", "ag_x_nose", "ag_y_tail_base", "tg_x_nose", "tg_y_tail_base"))


def normalize_coords(s: SparkSession, d: str) -> DataFrame:
    return six(geometry.normalize_xy(fx.wide(s, d), fx.meta(s, d)).select("video_id", "mouse_id", "video_frame", "x_nose", "y_neck"))


def body_geometry(s: SparkSession, d: str) -> DataFrame:
    by = ["video_id", "mouse_id"]
    g = geometry.body_geometry(fx.wide(s, d), "").withColumn("ref_len", geometry.reference_length("med_body_len", "body_len", by))
    return six(g.select(*by, "video_frame", *[f"{a}_{p}" for p in ("center", "upper", "lower") for a in "xy"], "body_len", "unit_x", "unit_y", "ref_len"))


def ear_gap(s: SparkSession, d: str) -> DataFrame:
    w = fx.wide(s, d)
    return six(w.select("video_id", "mouse_id", "video_frame", geometry.ear_gap(w.columns, F.lit(1.0)).alias("ear_gap")))


def pair_distances(s: SparkSession, d: str) -> DataFrame:
    out = geometry.pair_distances(fx.pair_rows(s, d), ["nose", "neck", "tail_base"], K4)
    return six(out.toDF(*[c.replace("+", "_") for c in out.columns]))


def _lagged(s: SparkSession, d: str) -> kinematics.Lags:
    lags = kinematics.Lags(fx.wide(s, d), fx.meta(s, d), fx.LAG_SEC, ["video_id", "mouse_id"])
    lags.masks()
    return lags


def lag_structure(s: SparkSession, d: str) -> DataFrame:
    return _lagged(s, d).table.select("video_id", "mouse_id", "video_frame", "kf", "ok1", "ok2", "ok3")


def lagged_rates(s: SparkSession, d: str) -> DataFrame:
    lags = _lagged(s, d)
    x, y = F.col("x_nose").cast("double"), F.col("y_nose").cast("double")
    return six(lags.table.select("video_id", "mouse_id", "video_frame", lags.rate(x).alias("vx"), lags.rate(F.atan2(y, x), angle=True).alias("turn")))


def invariants(s: SparkSession, d: str) -> DataFrame:
    return six(kinematics.pair_invariants(fx.pair_rows(s, d), fx.meta(s, d), lag_sec=fx.LAG_SEC, norm_by="med_body_len").drop("aug"))


def single_mouse(s: SparkSession, d: str) -> DataFrame:
    return six(kinematics.single_mouse(fx.pair_rows(s, d), fx.meta(s, d), lag_sec=fx.LAG_SEC, norm_by="frame_body_len").drop("aug"))


def temporal_feats(s: SparkSession, d: str) -> DataFrame:
    rows = fx.pair_rows(s, d).select("aug", *K4, F.col("ag_x_nose").cast("double").alias("v"))
    return six(kinematics.lag_window_stats(rows, fx.meta(s, d), ["v", "absent"], lag_sec=fx.LAG_SEC).drop("aug"))


def submit(s: SparkSession, d: str) -> DataFrame:
    out, _ = tune.prepare_submit(fx.scaled(s, d), fx.whitelist(s, d), parse.action_durations(fx.annotations(s, d)), fx.solution(s, d), tune.DEFAULT_GRID)
    return out


def solution_json(s: SparkSession, d: str) -> DataFrame:
    return fx.solution(s, d)


def overlap_check(s: SparkSession, d: str) -> DataFrame:
    a = fx.annotations(s, d)
    shifted = a.withColumns({"start_frame": F.col("start_frame") + 1, "stop_frame": F.col("stop_frame") + 2})
    both = a.unionByName(shifted).select("video_id", "agent_id", "target_id", "action", "start_frame", "stop_frame")
    return score.overlap_flags(both)


def validate_report(s: SparkSession, d: str) -> DataFrame:
    return score.validation_report(fx.solution(s, d), fx.submission(s, d))


def interval_overlap(s: SparkSession, d: str) -> DataFrame:
    return score.interval_overlap(fx.solution(s, d), fx.submission(s, d), score.KEY)


def fbeta_by_action(s: SparkSession, d: str) -> DataFrame:
    return six(score.fbeta_stats(fx.solution(s, d), fx.submission(s, d)))


def fbeta_macro(s: SparkSession, d: str) -> DataFrame:
    return six(score.macro_scores(score.fbeta_stats(fx.solution(s, d), fx.submission(s, d)))["macro"])


def raw_vs_post_scores(s: SparkSession, d: str) -> DataFrame:
    p, truth = fx.preds(s, d), fx.solution(s, d)
    raw = score.fbeta_stats(truth, post.get_intervals(post.argmax_frames(p)))
    smooth = post.smooth_scores(p, parse.action_durations(fx.annotations(s, d)))
    done = score.fbeta_stats(truth, post.get_intervals(post.argmax_frames(smooth, fx.SUBMIT_Z)))
    one = raw.select("lab_id", "action", F.col("f_beta").alias("f_raw"))
    return six(one.join(done.select("lab_id", "action", F.col("f_beta").alias("f_post")), ["lab_id", "action"]))


def tune_z(s: SparkSession, d: str) -> DataFrame:
    return six(tune.tune_per_action(fx.scaled(s, d), fx.solution(s, d), tune.DEFAULT_GRID))


def tune_z_per_lab(s: SparkSession, d: str) -> DataFrame:
    return six(tune.tune_per_lab(fx.scaled(s, d), fx.solution(s, d), tune.DEFAULT_GRID))


def _platt_table(s: SparkSession, d: str) -> DataFrame:
    n = F.length("action")
    return fx.preds(s, d).select("action").distinct().select("action", (n / 100.0).alias("a"), (-n / 10.0).alias("b"), (n / 20.0).alias("prior"))


def platt_apply(s: SparkSession, d: str) -> DataFrame:
    out = calibrate.apply_platt(fx.preds(s, d), _platt_table(s, d))
    return out.select(*K4, "action", F.round("calibrated", 3).cast("double").alias("calibrated")).transform(lambda x: six(x.withColumn("calibrated", F.round("calibrated", 3))))


def prob_to_logit(s: SparkSession, d: str) -> DataFrame:
    p = F.col("score").cast("double") / 100
    return six(fx.preds(s, d).select(*K4, "action", logit(p).alias("logit")))


def logloss(s: SparkSession, d: str) -> DataFrame:
    p = sigmoid((F.col("score").cast("double") - 50) / 20)
    rows = fx.preds(s, d).select("action", p.alias("p"), (F.col("video_frame") % 2).alias("y"))
    return six(model.log_loss(rows, ["action"]))


def neg_classes(s: SparkSession, d: str) -> DataFrame:
    return sampling.negative_classes(fx.labelled_spine(s, d), fx.whitelist(s, d), "view")


def sample_by_video(s: SparkSession, d: str) -> DataFrame:
    return sampling.sample_by_video(fx.frame_labels(s, d), 30, 1)


def sample_unlabelled(s: SparkSession, d: str) -> DataFrame:
    return sampling.sample_unlabelled(fx.frame_labels(s, d), 10, 1)


def fold_membership(s: SparkSession, d: str) -> DataFrame:
    return sampling.make_folds(fx.frame_labels(s, d), "view", 3, 42, num_models=7)


def fold_rows(s: SparkSession, d: str) -> DataFrame:
    """Training rows of the first fold: all positives, half of the real negatives, a fifth of the others."""
    rows = fx.frame_labels(s, d)
    return sampling.fold_rows(rows, fx.whitelist(s, d), sampling.make_folds(rows, "view", 3, 42), 0, "view", 50, 20, 5)["train"]


def augmented_train(s: SparkSession, d: str) -> DataFrame:
    """Augmented copies of a fold's validation recordings leave its training rows."""
    rows = fx.frame_labels(s, d)
    valid = sampling.make_folds(rows, "view", 3, 42).where("fold = 0 and role = 'val'").select(F.col("video_id").cast("int").alias("video_id"))
    both = rows.withColumn("aug", F.lit(False)).unionByName(rows.withColumn("aug", F.lit(True)))
    return sampling.augmented_train_only(both, valid)


def run_weights(s: SparkSession, d: str) -> DataFrame:
    rows = post.argmax_frames(fx.scores(s, d)).select(*K4, "action")
    return six(sampling.run_weights(rows, "view"))


def _pseudo(s: SparkSession, d: str) -> DataFrame:
    return post.argmax_frames(fx.scores(s, d, 2), 30.0).select(*K4, "action")


def pseudo_mask(s: SparkSession, d: str) -> DataFrame:
    allowed = fx.whitelist(s, d).where("action <> 'view'")
    return sampling.pseudo_mask(fx.labelled_spine(s, d), _pseudo(s, d), allowed)


def pseudo_labels(s: SparkSession, d: str) -> DataFrame:
    """Masked rows take the action; their weight is that of pseudo-labels."""
    rows = fx.labelled_spine(s, d).withColumn("weight", F.lit(1.0))
    return sampling.relabel(rows, pseudo_mask(s, d), "view", 0.25)


def dilate_labels(s: SparkSession, d: str) -> DataFrame:
    return augment.dilate_labels(fx.labelled_spine(s, d), fx.meta(s, d), 0.2).select(*K4, "action", "near_label")


def fill_zeros(s: SparkSession, d: str) -> DataFrame:
    full = spine.pair_spine(fx.wide(s, d), spine.expand_to_frames(fx.annotations(s, d)), fx.whitelist(s, d))
    return six(spine.fill_missing(full, "zeros").select(*K4, "action", "ag_x_nose", "ag_y_neck", "tg_x_neck", "tg_y_tail_base"))


def submit_per_lab(s: SparkSession, d: str) -> DataFrame:
    """Scores with a background action: one threshold per laboratory."""
    preds = fx.scaled(s, d).withColumn("action", F.when(F.col("action") == "error", spine.NOTHING).otherwise(F.col("action")))
    out, _ = tune.prepare_submit(preds, fx.whitelist(s, d), 3, fx.solution(s, d), tune.DEFAULT_GRID)
    return out


def evaluate_scores(s: SparkSession, d: str) -> DataFrame:
    """F-beta of the plain argmax and of the tuned intervals, by laboratory and action."""
    found = dataset.evaluate(fx.scaled(s, d), fx.solution(s, d), fx.whitelist(s, d), parse.action_durations(fx.annotations(s, d)), tune.DEFAULT_GRID)
    raw, done = (found[k]["all_stats"].select("lab_id", "action", F.col("f_beta").alias(n)) for k, n in (("raw", "f_raw"), ("postproc", "f_post")))
    return six(raw.join(done, ["lab_id", "action"]))


def bidir_fill(s: SparkSession, d: str) -> DataFrame:
    rows = fx.pair_rows(s, d).select(*K4, F.col("ag_x_nose").alias("x_nose"), F.col("tg_y_tail_base").alias("y_tail_base"))
    return six(spine.fill_both_ways(rows, FILL))


def class_counts(s: SparkSession, d: str) -> DataFrame:
    return spine.class_counts(fx.labelled_spine(s, d))


def class_encode(s: SparkSession, d: str) -> DataFrame:
    return spine.encode_classes(fx.preds(s, d))


def grid_expand(s: SparkSession, d: str) -> DataFrame:
    rows = [(float(c["sample_neg_percent"]), float(c["sample_unl_percent"])) for c in tune.sample_grid([10, 20, 50], [0, 5])]
    return s.createDataFrame(rows, "neg double, unl double")


def wide_scores_pivot(s: SparkSession, d: str) -> DataFrame:
    return six(_wide_scores(s, d)[0])


def stream_intervals(s: SparkSession, d: str) -> DataFrame:
    from ..streaming.intervals import stream_intervals as run

    return run(post.argmax_frames(fx.preds(s, d), fx.SUBMIT_Z))


def long_smoothing(s: SparkSession, d: str) -> DataFrame:
    """Running-sum windows over a long history: line items as frames of ten recordings, whole prices as scores."""
    days = F.expr("cast(datediff(cast(l_shipdate as date), date'1990-01-01') as int)")
    keys = [F.lit(0).alias("lab_id"), (F.col("l_suppkey") % 10).cast("int").alias("video_id"), F.lit(1).alias("agent_id"), F.lit(1).alias("target_id"), F.concat("l_returnflag", "l_linestatus").alias("action"), days.alias("video_frame")]
    rows = fx.table(s, d, "lineitem").groupBy(*keys).agg(F.floor(F.max("l_extendedprice")).cast("float").alias("score"))
    return six(post.smooth_scores(rows, 201).select("video_id", "action", "video_frame", "score"))


def build_dataset(s: SparkSession, d: str) -> DataFrame:
    p = dataset.FeatureParams(["nose", "neck", "tail_base", "ear_left", "ear_right", "body_center"], fx.LAG_SEC, window_cols=["r_center"], augment=True)
    labels = spine.expand_to_frames(fx.annotations(s, d))
    return dataset.build_dataset(fx.tracks(s, d), labels, fx.meta(s, d), fx.whitelist(s, d), p)


def augment_rows(s: SparkSession, d: str) -> DataFrame:
    labels = spine.expand_to_frames(fx.annotations(s, d))
    rows = spine.pair_spine(fx.wide(s, d), labels, fx.whitelist(s, d))
    return augment.add_augmented_blocks(rows, fx.meta(s, d), 0.2, seed=3)


def platt_fit(s: SparkSession, d: str) -> DataFrame:
    rows = fx.preds(s, d).select("action", ((F.col("score") - 50) / 20).alias("score"), (F.col("score") + F.col("video_frame") % 50 > 60).cast("int").alias("y"))
    return six(calibrate.fit_platt(rows))


def gbt_oof(s: SparkSession, d: str) -> DataFrame:
    wide = _wide_scores(s, d)[0].fillna(0)
    truth = post.argmax_frames(fx.scores(s, d, 0), fx.TRUTH_Z).select(*K4, "action")
    rows = wide.join(truth, K4, "left").withColumn("action", F.coalesce("action", F.lit(spine.NOTHING)))
    actions = ["click", "error", "purchase", "signup", "view"]
    heads = model.BoostedHeads(actions, actions, folds=2, params={"maxIter": 3, "maxDepth": 3}, use_weights=True)
    return heads.fit(rows, fx.whitelist(s, d))["oof"]


ALL = (
    intervals, smooth_scores, argmax_filter, whitelist_filter, melt_scores, wide_scores_pivot, whitelist_parse, bodypart_intersection, action_duration, expand_intervals,
    tracks_wide, pair_spine, normalize_coords, body_geometry, ear_gap, pair_distances, lag_structure, lagged_rates, invariants, single_mouse, temporal_feats, submit, submit_per_lab, evaluate_scores,
    solution_json, overlap_check, validate_report, interval_overlap, fbeta_by_action, fbeta_macro, raw_vs_post_scores, tune_z, tune_z_per_lab, platt_apply, prob_to_logit,
    logloss, neg_classes, sample_by_video, sample_unlabelled, fold_membership, fold_rows, augmented_train, run_weights, pseudo_mask, pseudo_labels, dilate_labels, fill_zeros, bidir_fill, class_counts, class_encode, grid_expand, stream_intervals,
    long_smoothing, build_dataset, augment_rows, platt_fit, gbt_oof,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}
