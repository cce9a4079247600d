"""Model adapters with one contract: ``fit(train) -> dict`` and ``predict(rows)`` with a score per action.

Boosters are Spark's gradient-boosted trees, one per action and fold; the network is Spark's
multilayer perceptron over all actions. Both run distributed and save as Spark pipelines.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import QuantileDiscretizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clip, logit
from ..functions.tables import materialise, table_exists
from . import calibrate, sampling

KEYS = ["video_id", "agent_id", "target_id", "video_frame"]


@dataclass
class ActionPlan:
    """What one action's model sees."""

    action: str
    self_action: bool
    features: list[str]

    def rows(self, dt: DataFrame) -> DataFrame:
        same = F.col("agent_id") == F.col("target_id")
        return dt.where(same if self.self_action else ~same)


def plan_action(dt: DataFrame, action: str, features: Sequence[str], windows_by_action: dict[str, Sequence[str]] | None = None) -> ActionPlan:
    """Rows and features of an action: windows configured for it, and only the mouse's own features if it acts on itself."""
    first = dt.where(F.col("action") == action).agg(F.count(F.lit(1)).alias("n"), F.min((F.col("agent_id") == F.col("target_id")).cast("int")).alias("own")).first()
    if not first["n"]:
        raise ValueError(f"No positives for action {action}")
    allowed = (windows_by_action or {}).get(action)
    window = re.compile(r"_lagw\d+_")
    chosen = [f for f in features if not window.search(f) or allowed is None or f in allowed]
    if first["own"]:
        chosen = [f for f in chosen if "ag_" in f or "m1m1" in f]
    return ActionPlan(action, bool(first["own"]), chosen)


def params_by_action(actions: Sequence[str], defaults: dict, overrides: dict | None) -> dict[str, dict]:
    """Overrides hold for all actions unless every key of theirs is an action."""
    overrides = overrides or {}
    if overrides and set(overrides) <= set(actions):
        return {a: defaults | (overrides.get(a) or {}) for a in actions}
    return {a: defaults | overrides for a in actions}


def safe_name(feature: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", feature)


def _assembled(dt: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Numeric features under names that the assembler accepts."""
    names = [safe_name(f) for f in features]
    return dt.withColumns({n: F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f, n in zip(features, names, strict=True)}), names


def margin(column: str = "rawPrediction") -> Column:
    return vector_to_array(column)[1]


@dataclass
class BoostedHeads:
    """One boosted classifier per action and fold, calibrated on out-of-fold margins.

    ``num_models`` asks for that many folds from repeated deals; a row's margins are averaged before calibration. With
    ``early_stopping`` boosting ends when the validation recordings' loss no longer falls by ``validationTol``. An action
    with a single fold has no validation recordings: its head sees all rows and gives no out-of-fold scores.
    """

    actions: Sequence[str]
    features: Sequence[str]
    folds: int = 5
    seed: int = 42
    num_models: int | None = None
    params: dict = field(default_factory=dict)
    neg_percent: float | None = None
    unl_percent: float | None = None
    use_weights: bool = False
    use_calibration: bool = True
    early_stopping: bool = False
    pseudo_weight: float = 0.0
    windows_by_action: dict | None = None
    models: dict = field(default_factory=dict)
    platt: dict = field(default_factory=dict)

    DEFAULTS = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1}
    OOF = "video_id string, agent_id int, target_id int, video_frame int, action string, score float"

    def fit(self, train: DataFrame, whitelist: DataFrame, pseudo: DataFrame | None = None) -> dict:
        """Fits all heads. The table is written once, so that no fit computes its features again."""
        spark = train.sparkSession
        oof, summary = [], []
        train = materialise(train, "model-table")
        mask = materialise(sampling.pseudo_mask(train, pseudo, whitelist), "pseudo-mask") if pseudo is not None else None
        settings = params_by_action(list(self.actions), self.DEFAULTS, self.params)
        for action in self.actions:
            plan = plan_action(train, action, self.features, self.windows_by_action)
            rows = plan.rows(train)
            folds = materialise(sampling.make_folds(rows, action, self.folds, self.seed, self.num_models), "folds")
            count = folds.agg(F.max("fold")).first()[0] + 1
            held = folds.where("role = 'train'").limit(1).count() > 0
            heads, parts = [], []
            for fold in range(count):
                sets = sampling.fold_rows(rows, whitelist, folds, fold, action, self.neg_percent, self.unl_percent, self.seed)
                data = sets["train"] if held else sets["valid"]
                data = sampling.run_weights(data, action) if self.use_weights else data.withColumn("weight", F.lit(1.0))
                if mask is not None:
                    data = sampling.relabel(data, mask.withColumn("video_id", F.col("video_id").cast("string")), action, self.pseudo_weight)
                stop = {}
                if self.early_stopping and held:
                    stop = {"validationIndicatorCol": "watched"}
                    watched = sets["valid"].withColumns({"weight": F.lit(1.0), "watched": F.lit(True)})
                    data = data.withColumn("watched", F.lit(False)).unionByName(watched, allowMissingColumns=True)
                data, names = _assembled(data.withColumn("y", (F.col("action") == action).cast("double")), plan.features)
                booster = GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", seed=self.seed, **stop, **settings[action])
                head = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), booster]).fit(data)
                heads.append(head)
                valid, _ = _assembled(sets["valid"], plan.features)
                parts.append(head.transform(valid).select(*KEYS, (F.col("action") == action).cast("int").alias("y"), margin().alias("score"), F.lit(fold).alias("fold")))
            scored = materialise(reduce(DataFrame.unionByName, parts).withColumn("action", F.lit(action)), "margins")
            self.models[action] = (plan, heads)
            if self.use_calibration:
                self.platt[action] = calibrate.fit_platt(calibrate.mean_margins(scored, KEYS))
            if held:
                both = calibrate.cross_fit(scored, KEYS) if self.use_calibration else calibrate.mean_margins(scored, KEYS).withColumn("calibrated", F.col("score"))
                oof.append(both.select(*KEYS, "action", F.col("calibrated").cast("float").alias("score")))
            summary.append((action, count, plan.self_action, len(plan.features)))
        none = spark.createDataFrame([], self.OOF)
        return {"actions": list(self.actions), "feature_cols": list(self.features), "summary": summary, "calibs": self.platt, "oof": reduce(DataFrame.unionByName, oof) if oof else none}

    def predict(self, dt: DataFrame) -> DataFrame:
        """Wide scores: the mean over an action's models of their calibrated margins; rows it does not cover are NULL."""
        out = dt.select(*KEYS).distinct()
        for action, (plan, heads) in self.models.items():
            rows, names = _assembled(plan.rows(dt), plan.features)
            keep = [*KEYS, *names]
            rows = rows.select(*keep).dropDuplicates(KEYS)
            columns = []
            for i, head in enumerate(heads):
                rows = head.transform(rows).withColumn(f"m{i}", margin()).drop("x", "rawPrediction", "probability", "prediction")
                columns.append(f"m{i}")
            long = rows.select(*KEYS, F.lit(action).alias("action"), F.explode(F.array(*columns)).alias("score"))
            long = calibrate.apply_platt(long, self.platt[action]) if action in self.platt else long.withColumn("calibrated", F.col("score"))
            out = out.join(long.groupBy(*KEYS).agg(F.avg("calibrated").cast("float").alias(action)), KEYS, "left")
        return out

    def save(self, path: str) -> None:
        """Heads as Spark pipelines, calibration as tables, and one small table that says what belongs to what."""
        spark = SparkSession.active()
        plans = [(a, i, safe_name(a), p.self_action, list(p.features), len(heads)) for i, (a, (p, heads)) in enumerate(self.models.items())]
        spark.createDataFrame(plans, "action string, place int, folder string, self_action boolean, features array<string>, heads int").coalesce(1).write.mode("overwrite").parquet(f"{path}/plans")
        for action, (_, heads) in self.models.items():
            for i, head in enumerate(heads):
                head.write().overwrite().save(f"{path}/{safe_name(action)}/fold={i}")
            if action in self.platt:
                self.platt[action].withColumn("action", F.lit(action)).write.mode("overwrite").parquet(f"{path}/{safe_name(action)}/platt")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedHeads:
        """Heads that predict as the saved ones did."""
        rows = spark.read.parquet(f"{path}/plans").orderBy("place").collect()
        every = list(dict.fromkeys(f for r in rows for f in r["features"]))
        heads = cls([r["action"] for r in rows], every)
        for r in rows:
            models = [PipelineModel.load(f"{path}/{r['folder']}/fold={i}") for i in range(r["heads"])]
            heads.models[r["action"]] = (ActionPlan(r["action"], r["self_action"], list(r["features"])), models)
            if table_exists(spark, f"{path}/{r['folder']}/platt"):
                heads.platt[r["action"]] = spark.read.parquet(f"{path}/{r['folder']}/platt")
        return heads


@dataclass
class MulticlassNet:
    """A multilayer perceptron over all actions, ``Nothing`` included."""

    features: Sequence[str]
    hidden: Sequence[int] = (32,)
    epochs: int = 50
    folds: int = 3
    seed: int = 42
    scaler: str = "standard"
    unl_percent: float | None = None
    models: list = field(default_factory=list)
    labels: list = field(default_factory=list)

    def _preprocess(self, names: list[str]) -> list:
        if self.scaler == "quantile":
            bins = QuantileDiscretizer(inputCols=names, outputCols=[f"{n}_q" for n in names], numBuckets=32, handleInvalid="keep")
            return [bins, VectorAssembler(inputCols=[f"{n}_q" for n in names], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]
        return [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]

    def fit(self, train: DataFrame, pseudo: DataFrame | None = None) -> dict:
        train = materialise(train, "model-table")
        indexer = StringIndexer(inputCol="action", outputCol="y", stringOrderType="alphabetAsc").fit(train)
        self.labels = list(indexer.labels)
        sizes = {r["video_id"]: r["n"] for r in train.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = []
        for fold in sampling.group_folds(sizes, self.folds):
            valid = train.where(F.col("video_id").isin(fold))
            rest = train.where(~F.col("video_id").isin(fold)) if len(sizes) > 1 else train
            rest = sampling.augmented_train_only(rest, valid) if "aug" in train.columns else rest
            data, names = _assembled(indexer.transform(sampling.sample_unlabelled(rest, self.unl_percent, self.seed)), self.features)
            net = MultilayerPerceptronClassifier(layers=[len(names), *self.hidden, len(self.labels)], featuresCol="x", labelCol="y", maxIter=self.epochs, seed=self.seed)
            model = Pipeline(stages=[*self._preprocess(names), net]).fit(data)
            self.models.append(model)
            parts.append(self._scores([model], valid))
        return {"actions": self.labels, "feature_cols": list(self.features), "oof": reduce(DataFrame.unionByName, parts)}

    def _scores(self, models: list, dt: DataFrame) -> DataFrame:
        """Long log-odds of every action: of the mean of the models' probabilities."""
        rows, _ = _assembled(dt, self.features)
        sums = [F.lit(0.0)] * len(self.labels)
        for i, model in enumerate(models):
            added = set(model.transform(rows.limit(0)).columns) - set(rows.columns)
            rows = model.transform(rows).withColumn(f"p{i}", vector_to_array("probability")).drop(*added)
            sums = [s + F.col(f"p{i}")[k] for k, s in enumerate(sums)]
        odds = [logit(clip(s / len(models))).cast("float").alias(a) for a, s in zip(self.labels, sums, strict=True)]
        return rows.select(*KEYS, *odds).unpivot(KEYS, self.labels, "action", "score").where("score is not null")

    def predict(self, dt: DataFrame) -> DataFrame:
        """Wide log-odds; frames that stand in several rows are averaged."""
        means = [F.avg(F.when(F.col("action") == a, F.col("score"))).cast("float").alias(a) for a in self.labels]
        return self._scores(self.models, dt).groupBy(*KEYS).agg(*means)

    def save(self, path: str) -> None:
        row = (list(self.labels), list(self.features), len(self.models), self.scaler)
        SparkSession.active().createDataFrame([row], "labels array<string>, features array<string>, models int, scaler string").coalesce(1).write.mode("overwrite").parquet(f"{path}/net")
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/fold={i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MulticlassNet:
        r = spark.read.parquet(f"{path}/net").first()
        models = [PipelineModel.load(f"{path}/fold={i}") for i in range(r["models"])]
        return cls(list(r["features"]), scaler=r["scaler"], folds=r["models"], models=models, labels=list(r["labels"]))


def log_loss(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of -log of the probability ``p`` of the true class ``y`` (0 or 1), clipped at 1e-6."""
    q = clip(F.col("p"))
    return rows.groupBy(*by).agg((-F.avg(F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("log_loss"))
