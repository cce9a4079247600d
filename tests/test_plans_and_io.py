"""Plan shapes, sources and sinks, models, streaming."""


import pytest
from pyspark.sql import functions as F

from trackloom.operators import geometry, kinematics, model, post
from trackloom.plans import dataset, fixtures
from trackloom.sources import readers, writers
from trackloom.streaming.intervals import PAIR, stream_intervals

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_argmax_is_a_group_limit_and_islands_take_one_exchange(spark):
    rows = fixtures.preds(spark, SF)
    assert "WindowGroupLimit" in plan(post.argmax_frames(rows))
    smooth = post.smooth_scores(spark.read.parquet(f"{SF}/events.parquet").selectExpr("0 lab_id", "1 video_id", "1 agent_id", "1 target_id", "event_type action", "cast(event_id as int) video_frame", "cast(value as float) score"), 5)
    text = plan(smooth)
    assert text.count("Exchange hashpartitioning") == 1 and "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in text


def test_one_exchange_serves_smoothing_argmax_and_islands(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("0 lab_id", "cast(user_id as int) video_id", "1 agent_id", "1 target_id", "event_type action", "cast(event_id as int) video_frame", "cast(value as float) score")
    text = plan(post.get_intervals(post.argmax_frames(post.smooth_scores(post.by_recording(rows), 5), 1.0)))
    assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in text


def test_filters_reach_the_scan(spark):
    text = plan(fixtures.table(spark, SF, "events").where("event_type = 'view'"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in text


def test_lags_of_two_rates_share_one_exchange(spark):
    out = kinematics.add_lag_structure(fixtures.wide(spark, SF), fixtures.meta(spark, SF), 0.1, ["video_id", "mouse_id"], values=[2, 3])
    assert plan(out).count("Exchange hashpartitioning(video_id#") <= 3


def test_rotation_does_not_change_invariants(spark):
    import math

    dt = fixtures.pair_rows(spark, SF)
    c, s = math.cos(0.7), math.sin(0.7)
    turned = dt
    for x in [n for n in dt.columns if n[2:5] == "_x_"]:
        y = x.replace("_x_", "_y_")
        turned = turned.withColumns({x: F.col(x).cast("double") * c - F.col(y).cast("double") * s, y: F.col(x).cast("double") * s + F.col(y).cast("double") * c})
    names = ["r_center", "long", "lat", "dr_center", "v_long", "motion_parallel"]
    sums = [kinematics.pair_invariants(t, fixtures.meta(spark, SF), lag_sec=0.1, values=[2, 3]).where("agent_id <> target_id").agg(*[F.sum(n) for n in names]).first() for t in (dt, turned)]
    assert list(sums[0]) == pytest.approx(list(sums[1]), rel=1e-4, abs=1e-4)


def test_coordinate_columns():
    assert geometry.coordinate_columns(["x_nose", "ag_y_neck", "nose_x", "xy_nose", "relax_1", "y"]) == ["x_nose", "ag_y_neck", "nose_x", "y"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "meta.csv").write_text('lab_id,video_id,frames_per_second,pix_per_cm_approx,body_parts_tracked,behaviors_labeled,extra\nL,007,30,12.5,"[""nose""]",,x\nL,8,25,10,"[""nose""]","[""mouse1,self,rear""]",y\n')
    meta = readers.read_meta(spark, str(tmp_path / "meta.csv"))
    assert {r["video_id"]: r["behaviors_labeled"] for r in meta.collect()} == {"007": "[]", "8": '["mouse1,self,rear"]'}
    spark.createDataFrame([(1, 1, "rear", 0, 4), (1, 1, "ejaculate", 5, 6), (1, 1, None, 7, 9)], readers.ANNOTATION).toPandas().astype({"agent_id": "int32", "target_id": "int32", "start_frame": "int32", "stop_frame": "int32"}).to_parquet(_made(tmp_path / "ann/L") / "007.parquet")
    ann = readers.read_annotations(spark, str(tmp_path / "ann"), meta).collect()
    assert [(r["video_id"], r["lab_id"], r["action"]) for r in ann] == [("007", "L", "rear"), ("007", "L", None)]
    rows = spark.createDataFrame([(0, 1, "nose", 1.0, float("nan")), (1, 1, "tail", 1.0, 2.0)], readers.TRACK).toPandas().astype({"video_frame": "int32", "mouse_id": "int32", "x": "float32", "y": "float32"})
    for v in ("007", "8"):
        rows.to_parquet(_made(tmp_path / "tracks/L") / f"{v}.parquet")
    got = readers.read_tracks(spark, str(tmp_path / "tracks"), "L", ["nose"], videos=["8"])
    assert [(r["video_id"], r["bodypart"], r["y"]) for r in got.collect()] == [("8", "nose", None)]
    assert readers.read_tracks(spark, str(tmp_path / "tracks"), "L").count() == 4
    writers.write_tracks(readers.read_tracks(spark, str(tmp_path / "tracks"), "L").withColumn("lab_id", F.lit("L")), str(tmp_path / "layout"))
    assert "PartitionFilters: [isnotnull(lab_id" in plan(readers.read_partitioned_tracks(spark, str(tmp_path / "layout")).where("lab_id = 'L'"))
    assert readers.read_pseudo_labels(spark, None) is None


def test_reader_errors(spark, tmp_path):
    """Recordings without a file are left out, nested files are found, and nothing at all is an error."""
    rows = spark.createDataFrame([(0, 1, "nose", 1.0, 2.0)], readers.TRACK).toPandas().astype({"video_frame": "int32", "mouse_id": "int32", "x": "float32", "y": "float32"})
    rows.to_parquet(_made(tmp_path / "tracks/L/deep") / "v{1}.parquet")
    rows.to_parquet(tmp_path / "tracks/L/v2.parquet")
    tracks = str(tmp_path / "tracks")
    assert {r["video_id"] for r in readers.read_tracks(spark, tracks, "L", videos=["v{1}", "gone"]).collect()} == {"v{1}"}
    assert readers.read_tracks(spark, tracks, "L").count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_tracks(spark, tracks, "L", videos=["gone"])
    _made(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        readers.read_annotations(spark, str(tmp_path / "none"), spark.createDataFrame([], readers.META))
    with pytest.raises(ValueError):
        readers.read_tracks(spark, tracks, "L", videos=[])
    line = 'L,1,{},10,"[]","[]"\n'
    head = "lab_id,video_id,frames_per_second,pix_per_cm_approx,body_parts_tracked,behaviors_labeled\n"
    (tmp_path / "same.csv").write_text(head + line.format(30) * 2)
    assert readers.read_meta(spark, str(tmp_path / "same.csv")).count() == 1
    (tmp_path / "clash.csv").write_text(head + line.format(30) + line.format(25))
    with pytest.raises(Exception, match="different metadata rows of recording 1"):
        readers.read_meta(spark, str(tmp_path / "clash.csv")).collect()


def test_configuration_files_and_small_sinks(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("L:\n  rear:\n    window_cols: [v, w]\n")
    assert readers.read_mapping(str(tmp_path / "c.yaml"))["L"]["rear"] == {"window_cols": ["v", "w"]}
    (tmp_path / "list.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        readers.read_mapping(str(tmp_path / "list.yaml"))
    path = str(tmp_path / "best.yaml")
    writers.upsert_params(path, "m", "L", {"x": 1})
    writers.upsert_params(path, "m", "M", {"x": 2})
    writers.upsert_params(path, "m", "L", {"y": 3})
    assert readers.read_yaml(path) == {"m": {"L": {"y": 3}, "M": {"x": 2}}}
    for k in range(2):
        writers.append_trial(str(tmp_path / "trials.csv"), {"trial": k, "score": 0.5})
    assert (tmp_path / "trials.csv").read_text().split() == ["trial,score", "0,0.5", "1,0.5"]
    table = spark.createDataFrame([("L", "a", 1.5), ("M", "a", 2.5)], "lab_id string, action string, z_thr double")
    writers.write_small_csv(table, str(tmp_path / "thr"))
    assert spark.read.option("header", True).csv(str(tmp_path / "thr")).count() == 2
    writers.write_scores(table, str(tmp_path / "oof"))
    assert spark.read.parquet(str(tmp_path / "oof")).where("lab_id = 'M'").first()["z_thr"] == 2.5


def _made(path):
    path.mkdir(parents=True, exist_ok=True)
    return path


def test_run_log_grows_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_run_log(spark, path, "L", {"a": {"b": [1, 2]}}, 3, {"f": 0.123456})
    writers.append_run_log(spark, path, "L", {"c": 1}, 4, {"f": 0.5, "g": 0.25})
    rows = readers_sorted(writers.read_run_log(spark, path))
    assert rows[0]["a_b"] == "1,2" and rows[0]["f"] == 0.1235 and rows[0]["g"] is None and rows[1]["c"] == 1
    assert writers.flatten({"x": {"y": 1}, "z": [1, "b"]}) == {"x_y": 1, "z": "1,b"}


def readers_sorted(df):
    return sorted(df.collect(), key=lambda r: r["n_features"])


def test_window_configuration():
    found = readers.window_features("L", {"L": {"rear": {"window_cols": ["v"]}, "sniff": None}}, 2)
    assert found == {"window_cols": ["v"], "by_action": {"rear": ["v_lagw1_mean", "v_lagw2_mean"], "sniff": []}}
    for lab, config in (("M", {}), ("L", {"L": []}), ("L", {"L": {"rear": 3}})):
        if config.get(lab) == []:
            continue
        with pytest.raises(ValueError):
            readers.window_features(lab, config)


def test_dataset_has_every_feature_once(spark):
    p = dataset.FeatureParams(["nose", "neck", "tail_base"], 0.1, window_cols=["r_center"])
    from trackloom.operators import spine

    labels = spine.expand_to_frames(fixtures.annotations(spark, SF))
    out = dataset.build_dataset(fixtures.tracks(spark, SF), labels, fixtures.meta(spark, SF), fixtures.whitelist(spark, SF), p)
    assert len(out.columns) == len(set(out.columns)) == 6 + 25 + 26 + 2 * 3 + 9 + 3
    assert {t for c, t in out.dtypes if c not in ("aug", "video_id", "agent_id", "target_id", "video_frame", "action")} == {"float"}


def training_rows(spark):
    rows = [(str(v), 1, 2, f, "a" if (f // 5) % 2 else "Nothing", float((f // 5) % 2) + 0.01 * f, float(v)) for v in range(4) for f in range(40)]
    return spark.createDataFrame(rows, "video_id string, agent_id int, target_id int, video_frame int, action string, ag_v double, w_lagw1_mean double")


def test_boosted_heads_fit_and_predict(spark, tmp_path):
    rows = training_rows(spark)
    allowed = spark.createDataFrame([(str(v), 1, 2, "a") for v in range(4)], "video_id string, agent_id int, target_id int, action string")
    heads = model.BoostedHeads(["a"], ["ag_v", "w_lagw1_mean"], folds=2, params={"maxIter": 2, "maxDepth": 2}, windows_by_action={"a": []})
    oof = heads.fit(rows, allowed)["oof"]
    assert oof.count() == 160
    means = {r["y"]: r["m"] for r in oof.join(rows.select("video_id", "video_frame", (F.col("action") == "a").alias("y")), ["video_id", "video_frame"]).groupBy("y").agg(F.avg("score").alias("m")).collect()}
    assert means[True] > means[False]
    wide = heads.predict(rows)
    assert wide.columns == ["video_id", "agent_id", "target_id", "video_frame", "a"] and wide.where("a is not null").count() == 160
    heads.save(str(tmp_path / "models"))
    again = model.BoostedHeads.load(spark, str(tmp_path / "models"))
    assert sorted(map(tuple, again.predict(rows).collect())) == sorted(map(tuple, wide.collect()))


def test_early_stopping_repeats_and_single_folds(spark):
    rows = training_rows(spark).withColumn("ag_v", F.rand(3))
    allowed = spark.createDataFrame([(str(v), 1, 2, "a") for v in range(4)], "video_id string, agent_id int, target_id int, action string")
    params = {"maxIter": 30, "maxDepth": 2, "validationTol": 0.01}
    heads = model.BoostedHeads(["a"], ["ag_v"], folds=2, num_models=3, early_stopping=True, use_calibration=False, params=params)
    oof = heads.fit(rows, allowed)["oof"]
    assert oof.count() == 160 and len(heads.models["a"][1]) == 3
    assert all(h.stages[-1].getNumTrees < 30 for h in heads.models["a"][1])
    alone = model.BoostedHeads(["a"], ["ag_v"], folds=5, params={"maxIter": 2})
    assert alone.fit(rows.where("video_id = '1'"), allowed)["oof"].count() == 0 and len(alone.models["a"][1]) == 1


def test_multiclass_net(spark, tmp_path):
    net = model.MulticlassNet(["ag_v"], hidden=(4,), epochs=6, folds=2, unl_percent=50)
    found = net.fit(training_rows(spark))
    assert found["actions"] == ["Nothing", "a"] and found["oof"].count() == 320
    got = net.predict(training_rows(spark))
    assert got.columns == [*model.KEYS, "Nothing", "a"]
    # probabilities are averaged, then turned to log-odds
    import math

    row = training_rows(spark).where("video_id = '1' and video_frame = 7")
    data, _ = model._assembled(row, net.features)
    p = [m.transform(data).first()["probability"][1] for m in net.models]
    mean = min(max(sum(p) / len(p), 1e-6), 1 - 1e-6)
    want = math.log(mean / (1 - mean))
    assert got.where("video_id = '1' and video_frame = 7").first()["a"] == pytest.approx(want, rel=1e-4)
    net.save(str(tmp_path / "net"))
    again = model.MulticlassNet.load(spark, str(tmp_path / "net")).predict(training_rows(spark))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_action_parameters():
    assert model.params_by_action(["a", "b"], {"x": 1}, {"a": {"x": 2}}) == {"a": {"x": 2}, "b": {"x": 1}}
    assert model.params_by_action(["a"], {"x": 1}, {"x": 3}) == {"a": {"x": 3}}


def test_stream_equals_batch(spark, tmp_path):
    frames = post.argmax_frames(fixtures.preds(spark, SF), 20.0).select(*PAIR, "action", "video_frame")
    # in order of time, and one late frame to pass the watermark
    last = spark.createDataFrame([(99, 1, 1, "end", 10_000_000)], frames.schema)
    frames.orderBy("video_frame").coalesce(1).write.parquet(f"{tmp_path}/in")
    last.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in")
    q = stream_intervals(stream).writeStream.outputMode("append").format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("found").collect()))
    want = sorted((r["video_id"], int(r["agent_id"][5:]), int(r["target_id"][5:]), r["action"], r["start_frame"], r["stop_frame"]) for r in post.get_intervals(frames).collect())
    assert got == want
