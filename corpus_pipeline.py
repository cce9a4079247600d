"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it to the shared
folder and rereads it as the next stage's documents. Stages that filter return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontamination, harmonic_packing, jaccard, language_id, line_templates
from trackloom.llm.common import materialise, read_table

#: A document stays if its language is known with at least this probability.
MIN_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: documents without a letter or of no clear language go.

    That takes null and empty texts. Repeated rows and ties are judged one by one, very long texts as a whole; an empty table
    stays empty.
    """
    found = language_id.predict(docs, language_id.train(docs), label="__lang_pred", score="__lang_score")
    return found.where((F.col("__lang_pred") != language_id.UNKNOWN) & (F.col("__lang_score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2: recurring lines go from all but their first document, and documents of which nothing is left.

    Null and empty texts without dropped lines stay as they are; a tie of ids goes to the smallest text hash; rows of
    equal id and text are one document and lose the same lines.
    """
    found = line_templates.drop_repeated_lines(docs, counts=("__n_lines", "__n_dropped"))
    left = found.where((F.col("__n_dropped") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6 with a verdict by whole sets: of near-duplicates (5-word Jaccard similarity of 0.8 or more) one document stays.

    That is the one of the smallest (id, text hash); documents without an id come after all others. Null and empty texts are
    copies of each other, repeated rows are one document, rows of one id with different texts are documents of their own.
    """
    return jaccard.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: documents that hold a benchmark item within its error budget go.

    Null and empty texts hold none; repeated rows go or stay alike; an empty benchmark or table drops nothing.
    """
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4: what is left, as packed pieces of token ids; null and empty texts are one end id, repeated rows are packed each."""
    return harmonic_packing.harmonic_pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_templates", line_stage),
    ("simhash_bk", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("harmonic_packing", packing_stage),
]

#: A trained model decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
