"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over the whole text. Training bins each statistic at quantiles, grows
complete trees level by level from gradient histograms and stores them flattened: split features
and thresholds as (trees, 2**depth - 1) arrays and leaf values as (trees, 2**depth), which numpy
walks for a batch of rows and all trees at once.

The trees are fitted on a bounded sample: at most ``sample_rows`` labelled rows outside the held-out
fold, the first by (id hash, id, text hash). A threshold on the hash keeps every task's share of it small. Labels, language,
source and id are no inputs of a score.

Defined results: null and empty texts are scored by their (zero) statistics; very long texts are counted in parts, which
hold 16 bytes a word; a document labelled more than once takes the mean label; without labels every score is 0.5; repeated
rows are scored as rows of their own, and count once in the sample; a column that clashes with the score's name
gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_text, hash_share, held_out, map_text

_CLASSES = ("space", "newline", "lower", "upper", "digit", "stop", "comma", "shout", "bracket", "mark", "bar", "other", "lead", "tail")
_OF = np.full(256, _CLASSES.index("other"), np.uint8)
for _name, _chars in {"space": " \t\r", "newline": "\n", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".", "comma": ",;:", "shout": "!?", "bracket": "()[]{}<>", "mark": "*#$%&@^~=+", "bar": "|/\\_"}.items():
    _OF[[ord(c) for c in _chars]] = _CLASSES.index(_name)
_OF[0xC0:] = _CLASSES.index("lead")
_OF[0x80:0xC0] = _CLASSES.index("tail")

#: Characters of a long text that are counted together, and an odd factor that tells (a, b) from (b, a).
PART_CHARS, _PAIR = 1 << 20, 0x27D4EB2F165667C5
FEATURES = (*(f"{c}_share" for c in _CLASSES), "log_chars", "log_words", "word_chars", "unique_words", "unique_pairs", "log_lines", "unique_lines", "line_words", "marks_per_word", "shouts_per_word", "bars_per_word", "upper_of_letters", "longest_word")


def _word_hashes(text: str) -> tuple[np.ndarray, int, int]:
    """A hash of every word, the sum of the words' lengths and the longest one; a part of the text at a time."""
    hashes, total, longest = [], 0, 0
    for part in cut_text(text, PART_CHARS):
        words = part.split()
        sizes = list(map(len, words))
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        total, longest = total + sum(sizes), max(longest, max(sizes, default=0))
    return np.concatenate(hashes), total, longest


def statistics(text: str | None) -> np.ndarray:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    c = np.bincount(_OF[raw], minlength=len(_CLASSES)).astype(float)
    n = dict(zip(_CLASSES, c, strict=True))
    words, word_chars, longest = _word_hashes(text)
    lines = [hash(x) for x in text.split("\n") if x and not x.isspace()]
    w = max(len(words), 1)
    letters = max(n["lower"] + n["upper"] + n["lead"], 1)
    pairs = max(len(words) - 1, 1)
    with np.errstate(over="ignore"):
        joined = words[:-1] * np.int64(_PAIR) + words[1:]
    return np.array(
        [
            *(c / max(len(raw), 1)),
            np.log1p(len(text)),
            np.log1p(len(words)),
            word_chars / w,
            len(np.unique(words)) / w,
            len(np.unique(joined)) / pairs,
            np.log1p(len(lines)),
            len(set(lines)) / max(len(lines), 1),
            len(words) / max(len(lines), 1),
            n["mark"] / w,
            n["shout"] / w,
            n["bar"] / w,
            n["upper"] / letters,
            longest,
        ]
    )


@dataclass
class TreeEnsemble:
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray  # go right where the value is larger; +inf: always left
    leaf: np.ndarray  # trees x 2**depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        out = np.full(len(x), self.base)
        if not len(trees):
            return out
        inner = self.feature.shape[1]
        rows = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(trees)), np.int64)
        while at[0, 0] < inner if len(x) else False:
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return out + self.leaf[trees, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least_weight: float = 2.0) -> TreeEnsemble:
    """Newton boosting of the logistic loss over binned columns."""
    rows, columns = x.shape if x.ndim == 2 else (0, 0)
    inner = (1 << depth) - 1
    if not rows or y.min() == y.max():
        mean = float(np.clip(y.mean(), 0.01, 0.99)) if rows else 0.5
        return TreeEnsemble(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(mean / (1 - mean))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(columns)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(columns)], axis=1)
    cell = binned + np.arange(columns) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(rows, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(rows, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            flat = (cell + (node - first)[:, None] * columns * bins).ravel()
            shape = (width, columns, bins)
            hg = np.bincount(flat, np.repeat(g, columns), minlength=np.prod(shape)).reshape(shape).cumsum(axis=2)
            hh = np.bincount(flat, np.repeat(h, columns), minlength=np.prod(shape)).reshape(shape).cumsum(axis=2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
            gain[(hh < least_weight) | (th - hh < least_weight)] = 0
            for j in range(columns):
                gain[:, j, len(edges[j]) :] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            for k in np.flatnonzero(worth):
                j, b = divmod(int(best[k]), bins)
                feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(rows), feature[node]] > threshold[node])
        at = node - inner
        sg, sh = np.bincount(at, g, minlength=inner + 1), np.bincount(at, h, minlength=inner + 1)
        leaf = -rate * sg / (sh + l2)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return TreeEnsemble(np.array(features), np.array(thresholds), np.array(leaves), base)


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> TreeEnsemble:
    """Fit on labelled rows outside the held-out fold."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg(F.avg("y").alias("y"))
    # twice the bound in expectation, so that no task sends more than its share of that
    share = 2 * sample_rows / max(marked.count(), 1)
    chosen = marked.withColumn("h", F.xxhash64("doc_id")).where(hash_share(F.col("h")) < share).orderBy("h", "doc_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    counted = map_text(rows, lambda: lambda texts: {"x": [statistics(t).tolist() for t in texts]}, "x array<double>")
    once = counted.groupBy("h", "doc_id", F.xxhash64("text").alias("t")).agg(F.first("y").alias("y"), F.first("x").alias("x"))
    got = once.orderBy("h", "doc_id", "t").limit(sample_rows).select("y", "x").collect()
    return fit_trees(np.array([r["x"] for r in got]), np.array([float(r["y"] >= 0.5) for r in got]), **options)


def score(docs: DataFrame, model: TreeEnsemble, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of a good label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: {name: m.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES)))}

    return map_text(docs, make, f"`{name}` double", text_col=text_col)
