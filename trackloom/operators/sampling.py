"""Folds, negative classes, sampling, run weights and pseudo-labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import broadcast_if_small
from ..functions.windows import ordered, run_number
from .spine import NOTHING, PAIR


def seeded(seed: object, *columns: str | Column) -> Column:
    """A draw for each row that SQL can repeat: the MD5 of the seed and the row's keys, joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def make_folds(spine: DataFrame, action: str, k_folds: int, seed: int, num_models: int | None = None) -> DataFrame:
    """(fold, video_id, role): recordings in the order of a seeded draw, those with the action first, dealt round robin.

    Each fold thus holds a recording with the action; there are no more folds than such recordings. ``num_models`` asks
    for that many folds, from as many deals as they need. The table has a row per fold and recording.
    """
    videos = spine.groupBy(F.col("video_id").cast("string").alias("video_id")).agg(F.max((F.col("action") == action).cast("int")).alias("has"))
    n, good = videos.agg(F.count(F.lit(1)), F.sum("has")).first()
    k = max(1, min(k_folds, good or 0, n))
    wanted = num_models or k
    deals = videos.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-wanted // k) - 1))).alias("deal"))
    order = Window.partitionBy("deal").orderBy(F.col("has").desc(), seeded(seed, "deal", "video_id"), "video_id")
    own = deals.select("video_id", (F.col("deal") * k + (F.row_number().over(order) - 1) % k).alias("own"), "deal")
    each = own.select("*", F.explode(F.sequence(F.col("deal") * k, F.least((F.col("deal") + 1) * k, F.lit(wanted)) - 1)).alias("fold"))
    return each.select("fold", "video_id", F.when(F.col("own") == F.col("fold"), "val").otherwise("train").alias("role"))


def group_folds(sizes: dict, n_splits: int) -> list[list]:
    """Groups dealt to folds, largest first, each to the lightest fold."""
    n = min(n_splits, len(sizes))
    folds, weight = [[] for _ in range(n)], [0] * n
    for group, size in sorted(sizes.items(), key=lambda x: (-x[1], str(x[0]))):
        i = weight.index(min(weight))
        folds[i].append(group)
        weight[i] += size
    return folds


def negative_classes(spine: DataFrame, whitelist: DataFrame, action: str) -> DataFrame:
    """``neg_class``: positive; real (another action, or unlabelled where the pair may show it); maybe (the rest)."""
    pairs = whitelist.where(F.col("action") == action).select(*PAIR).distinct().withColumn("__may", F.lit(True))
    real = (F.col("action") != NOTHING) | F.coalesce("__may", F.lit(False))
    kind = F.when(F.col("action") == action, "positive").when(real, "real").otherwise("maybe")
    return spine.join(pairs, PAIR, "left").withColumn("neg_class", kind).select(*spine.columns, "neg_class")


def _ranked(rows: DataFrame, by: Sequence[str], seed: int) -> tuple[DataFrame, Window]:
    order = Window.partitionBy(*by).orderBy(seeded(seed, *PAIR, "video_frame", "action"), *PAIR, "video_frame", "action")
    return rows.withColumns({"__n": F.row_number().over(order), "__of": F.count(F.lit(1)).over(Window.partitionBy(*by))}), order


def sample_by_video(rows: DataFrame, percent: float | None, seed: int, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """The same share of each recording's rows, by hash order; None or 100 keeps all."""
    if percent is None or percent >= 100:
        return rows
    ranked, _ = _ranked(rows, by, seed)
    return ranked.where(F.col("__n") <= F.floor(F.col("__of") * percent / 100)).select(rows.columns)


def sample_unlabelled(rows: DataFrame, percent: float | None, seed: int) -> DataFrame:
    """All labelled rows; of each pair's unlabelled rows the share, but one at least."""
    if percent is None or percent >= 100:
        return rows
    ranked, _ = _ranked(rows.where(F.col("action") == NOTHING), PAIR, seed)
    kept = ranked.where(F.col("__n") <= F.greatest(F.floor(F.col("__of") * percent / 100), F.lit(1)))
    return rows.where(F.col("action") != NOTHING).unionByName(kept.select(rows.columns))


def fold_rows(spine: DataFrame, whitelist: DataFrame, folds: DataFrame, fold: int, action: str, neg_percent: float | None, unl_percent: float | None, seed: int) -> dict[str, DataFrame]:
    """Training rows (negatives sampled by class) and validation rows (all) of one fold."""
    own = broadcast_if_small(folds.where(F.col("fold") == fold).select("video_id", "role"))
    rows = negative_classes(spine, whitelist, action).withColumn("video_id", F.col("video_id").cast("string")).join(own, "video_id")
    train = rows.where("role = 'train'")
    parts = [train.where("neg_class = 'positive'"), sample_by_video(train.where("neg_class = 'real'"), neg_percent, seed), sample_by_video(train.where("neg_class = 'maybe'"), unl_percent, seed)]
    return {"train": parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("role"), "valid": rows.where("role = 'val'").drop("role")}


def augmented_train_only(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Training rows without augmented copies of validation recordings."""
    seen = valid.select("video_id").distinct().withColumn("__seen", F.lit(True))
    return train.join(broadcast_if_small(seen), "video_id", "left").where(~(F.col("aug") & F.coalesce("__seen", F.lit(False)))).select(train.columns)


def run_weights(rows: DataFrame, action: str) -> DataFrame:
    """``weight``: a positive counts 1/length of its run of positives, rescaled to sum to their number; negatives count 1.

    Runs follow a pair's row order; gaps in frames do not end them.
    """
    w = ordered(PAIR, ["video_frame", "action"])
    y = F.col("action") == action
    changed = F.coalesce(F.lag("__y").over(w), F.lit(False)) != F.col("__y")
    t = rows.withColumn("__y", y).withColumn("__run", run_number(changed, w))
    length = F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "__run"))
    t = t.withColumn("__w", F.when(F.col("__y"), 1.0 / length))
    total = t.agg((F.count("__w") / F.sum("__w")).alias("__k")).withColumn("__one", F.lit(1))
    t = t.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one")
    return t.withColumn("weight", F.when(F.col("__y"), F.col("__w") * F.col("__k")).otherwise(1.0)).select(*rows.columns, "weight")


def pseudo_mask(spine: DataFrame, pseudo: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(keys, pseudo_action): unlabelled rows with a pseudo-label whose action was not looked for in their pair."""
    keys = [*PAIR, "video_frame"]
    said = pseudo.select(*keys, F.col("action").alias("pseudo_action")).distinct()
    met = spine.where(F.col("action") == NOTHING).select(*keys).join(said, keys)
    looked = whitelist.select(*PAIR, F.col("action").alias("pseudo_action")).distinct()
    return met.join(looked, [*PAIR, "pseudo_action"], "left_anti").select(*keys, "pseudo_action")


def relabel(rows: DataFrame, mask: DataFrame, action: str, pseudo_weight: float | None = 0.0) -> DataFrame:
    """Masked rows take the action and, where asked, the weight of pseudo-labels."""
    keys = [*PAIR, "video_frame"]
    own = mask.where(F.col("pseudo_action") == action).select(*keys).withColumn("__p", F.lit(True))
    out = rows.join(own, keys, "left")
    hit = F.coalesce("__p", F.lit(False))
    out = out.withColumn("action", F.when(hit, F.lit(action)).otherwise(F.col("action")))
    if pseudo_weight is not None and "weight" in rows.columns:
        out = out.withColumn("weight", F.when(hit, F.lit(float(pseudo_weight))).otherwise(F.col("weight")))
    return out.select(rows.columns)


