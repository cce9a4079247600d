"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: hashed counts of the lower-cased text's 1- to 3-grams, 1 + log(count) times the inverse
document frequency, scaled to length 1. Document frequencies cover every training document
and are gathered as one vector of 2**bits counts per task. The weights are trained with
FTRL-proximal (per-coordinate rates, L1 and L2 penalties) on a bounded sample of at most
``sample_rows`` training documents, an equal share of it for each language, so that no learned language is missing:
those of smallest hash of (id, language, text). A temperature is then fitted on a tenth of the sample that the weights
have not seen.

Defined results: null text, empty text and text without a letter give ``und`` with score 0; rows of
null ``lang`` train nothing; without any training row every text is ``und``; repeated rows
are predicted as rows of their own, count as often in the frequencies, and once in the sample; of more languages than
``sample_rows`` each has one document; a very long text is counted in arrays of four bytes a character;
columns that clash with the result's names give way to them; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, held_out, map_batches, map_text

_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def ngram_counts(text: str, bits: int) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the whole lower-cased text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[1:] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
    three = (two[:-1] ^ (two[1:] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
    shift = np.uint32(32 - bits)
    total = np.zeros(1 << bits, np.int64)
    for h in (one, two, three):
        if len(h):
            total += np.bincount((h * np.uint32(0x27D4EB2F)) >> shift, minlength=1 << bits)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    idf: np.ndarray
    bits: int
    temperature: float = 1.0

    def vector(self, idx: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[idx]
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def logits(self, idx: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(idx, counts) @ self.weights[idx] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        counts = ngram_counts(text, self.bits)
        idx = np.flatnonzero(counts)
        p = softmax(self.logits(idx, counts[idx]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Ftrl:
    """FTRL-proximal for a softmax over sparse rows; the last coordinate is the bias."""

    def __init__(self, size: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, idx: np.ndarray, x: np.ndarray, label: int) -> None:
        rows, x = np.append(idx, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(rows)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        n = self.n[rows]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[rows] += g - sigma * w
        self.n[rows] = n + g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Minimises the negative log-likelihood over a log-spaced grid; 1 where there is nothing to fit."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    return min(np.geomspace(0.2, 5, 81), key=loss)


def _sparse(texts: list, bits: int) -> dict:
    rows = []
    for t in texts:
        c = ngram_counts(t, bits)
        i = np.flatnonzero(c)
        rows.append((i.astype("<u4").tobytes(), c[i].astype("<u4").tobytes()))
    return {"idx": [r[0] for r in rows], "counts": [r[1] for r in rows]}


def _frequencies(batches, bits: int):
    """Per task: documents with each bucket, and documents of each language."""
    df, languages = np.zeros(1 << bits, np.int64), Counter()
    for batch in batches:
        languages.update(batch.column(1).to_pylist())
        for t in batch.column(0).to_pylist():
            df += ngram_counts(t, bits) > 0
    seen = np.flatnonzero(df)
    names = [None] * len(seen) + list(languages)
    buckets = [*seen.tolist(), *[-1] * len(languages)]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(buckets, pa.int64()), pa.array([*df[seen].tolist(), *languages.values()], pa.int64())], names=["lang", "bucket", "n"])


def train(
    docs: DataFrame,
    *,
    sample_rows: int = 2000,
    bits: int = 14,
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-3,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Learn from the rows outside the held-out fold that have a language and a letter."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counted = map_batches(rows.select("text", "lang"), lambda it: _frequencies(it, bits), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    per_language = {r["lang"]: r["n"] for r in counted if r["bucket"] < 0}
    total = sum(per_language.values())
    if not total:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), np.zeros(1 << bits), bits)
    df = np.zeros(1 << bits)
    real = [(r["bucket"], r["n"]) for r in counted if r["bucket"] >= 0]
    df[[b for b, _ in real]] = [n for _, n in real]
    idf = np.log((1 + total) / (1 + df)) + 1
    languages = sorted(per_language)
    # tables of the driver go out as Arrow: rows would start a second kind of Python worker, which stays in each executor
    # twice each language's bound in expectation, but never so few that a small share finds none
    bound = max(sample_rows // len(languages), 1)
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": languages, "share": [(2 * bound + 20) / per_language[x] for x in languages]}))
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "lang", "text"))
    near = hashed.join(F.broadcast(shares), "lang").where(hash_share(F.col("h")) < F.col("share")).groupBy("lang", "h").agg(F.count(F.lit(1)).alias("copies"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= bound)
    chosen = docs.sparkSession.createDataFrame(ranked.select("lang", "h").toArrow())
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("h", "lang", "text")
    sample = map_text(sample, lambda: lambda texts: _sparse(texts, bits), "idx binary, counts binary").groupBy("h", "lang").agg(F.first("idx").alias("idx"), F.first("counts").alias("counts"))
    got = sorted((r["h"], r["lang"], r["idx"], r["counts"]) for r in sample.collect())
    languages = sorted({r[1] for r in got})
    model = LanguageModel(languages, np.zeros((1 << bits, len(languages)), np.float32), np.zeros(len(languages)), idf, bits)
    examples = [(i := np.frombuffer(a, "<u4"), c := np.frombuffer(b, "<u4"), model.vector(i, c), languages.index(lang)) for _, lang, a, b in got]
    calibration = [e for k, e in enumerate(examples) if k % 10 == 9]
    training = [e for k, e in enumerate(examples) if k % 10 != 9]
    learner, rng = Ftrl(1 << bits, len(languages), alpha, beta, l1, l2), np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(training)):
            idx, _, x, label = training[k]
            learner.step(idx, x, label)
    w = learner.weights()
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
    logits = np.array([model.logits(i, c) for i, c, _, _ in calibration]).reshape(-1, len(languages))
    model.temperature = float(fit_temperature(logits, np.array([e[3] for e in calibration], int)))
    return model


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts: list) -> dict:
            got = [m.predict(t) for t in texts]
            return {label: [g[0] for g in got], score: [g[1] if math.isfinite(g[1]) else 0.0 for g in got]}

        return run

    return map_text(docs, make, f"`{label}` string, `{score}` double", text_col=text_col)
