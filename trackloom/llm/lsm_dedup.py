"""Exact deduplication over a log-structured merge index of text digests (DataFrame operations only).

* **Memtable flush.** Each task digests its rows (SHA-256), sorts them and flushes one sorted run: a Parquet file. A batch's
  files are one run of level 0. A run that is probed gets a filter, a
  bitmap of fixed size over its digests.
* **Compaction.** Once a level holds ``fanout`` runs they are merged by digest into one run of the next level, with
  map-side combine, so a hot digest reaches its reducer as one row per task. A merged entry keeps one
  identifier (the smallest by default, the largest where a contract says so), the group's size and the row that stays.
* **Lookup.** A digest probes the filters of all runs, newest level first; only possible hits are joined with the runs.
* **Byte verification.** Of each digest that more than one row has, the least and the greatest text must be the same
  bytes. Both are aggregates with map-side combine: a group that holds a third of all rows sends one
  pair of texts per task, and no text meets its group in one place. A filter keeps texts of groups of one out of that
  shuffle. Should bytes differ under one digest, that digest's rows are grouped by the whole text instead.

Rows of hot digests get their entry by a broadcast of these (fewer than a fixed number); others meet it by a shuffle.

Defined results: null text counts as empty; of rows equal in text and id the first flushed stays; a null id loses to any
other; very long texts are digested and compared whole; columns other than id and text are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bitmap, materialise, probe_bitmap, spread_join


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Run:
    """A sorted run and its filter, which is made when it is first probed."""

    def __init__(self, rows: DataFrame, make_filter: Callable[[DataFrame], DataFrame], merged: bool):
        self.rows, self.merged, self._make, self._words = rows, merged, make_filter, None

    @property
    def words(self) -> DataFrame:
        if self._words is None:
            self._words = self._make(self.rows)
        return self._words


class DigestIndex:
    """Levels of sorted runs (digest, keep_id, keep_row, group_size) in the shared folder, each with its filter."""

    def __init__(self, spark: SparkSession, scratch: Scratch, *, keep: str = "smallest", fanout: int = 2, filter_bits: int = 1 << 24):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        if fanout < 2:
            raise ValueError("a merge takes two runs at least")
        self.spark, self.scratch, self.keep, self.fanout, self.filter_bits = spark, scratch, keep, fanout, filter_bits
        #: levels[k]: the runs of level k, oldest first.
        self.levels: list[list[Run]] = []

    def bit(self, digest: str = "digest") -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.filter_bits))

    def filter(self, run: DataFrame) -> DataFrame:
        return self.scratch.table(bitmap(run, self.bit()), "filter")

    def _merged(self, entries: DataFrame) -> DataFrame:
        """Entries of one digest as one; bitwise not turns the order of all longs around, without overflow."""
        turned = (lambda c: c) if self.keep == "largest" else F.bitwise_not
        best = F.max(F.struct(turned(F.col("keep_id")).alias("i"), F.bitwise_not("keep_row").alias("r")))
        merged = entries.groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
        return merged.select("digest", turned(F.col("best.i")).alias("keep_id"), F.bitwise_not("best.r").alias("keep_row"), "group_size")

    def add(self, rows: DataFrame) -> None:
        """A batch of flushed rows (digest, doc_id, row_no), sorted by task, as a run of level 0; full levels are compacted."""
        run = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row_no").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
        self._push(0, run)

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(Run(run, self.filter, merged=level > 0))
        if len(self.levels[level]) == self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """The runs of a level become one run of the next."""
        runs, self.levels[level] = [r.rows for r in self.levels[level]], []
        merged = self._merged(reduce(DataFrame.unionByName, runs)).sortWithinPartitions("digest")
        self._push(level + 1, self.scratch.table(merged, f"level-{level + 1}"))

    def compact_all(self) -> DataFrame:
        """One run of all entries, in which each digest stands once."""
        runs = [r for level in self.levels for r in level]
        if len(runs) != 1 or not runs[0].merged:
            merged = self._merged(reduce(DataFrame.unionByName, [r.rows for r in runs])).sortWithinPartitions("digest")
            runs = [Run(self.scratch.table(merged, "all"), self.filter, merged=True)]
        self.levels = [runs]
        return runs[0].rows

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The entries of those of ``digests`` that the index holds, merged over its runs."""
        found = []
        for level in self.levels:
            for run in reversed(level):
                hits = probe_bitmap(digests.select("digest").distinct(), self.bit(), run.words).where("in_bitmap").select("digest")
                found.append(run.rows.join(hits, "digest", "left_semi"))
        if not found:
            return self.spark.createDataFrame([], "digest binary, keep_id long, keep_row long, group_size long")
        return self._merged(reduce(DataFrame.unionByName, found))


def _digested(docs: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"))


def flush(rows: DataFrame, scratch: Scratch, batches: int) -> list[DataFrame]:
    """Memtables: each task's rows (digest, doc_id, row_no), sorted; one pass deals the tasks to ``batches`` folders."""
    entries = rows.select("digest", "doc_id", F.monotonically_increasing_id().alias("row_no"), F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"))
    entries = entries.sortWithinPartitions("batch", "digest")
    path = scratch.path("runs")
    entries.write.partitionBy("batch").parquet(path)
    read = rows.sparkSession.read.schema(entries.schema).parquet(path)
    return [read.where(F.col("batch") == k).drop("batch") for k in range(batches)]


def collisions(index: DigestIndex, docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Digests of ``repeated`` under which documents' bytes differ."""
    hits = probe_bitmap(docs, index.bit(), index.filter(repeated)).where("in_bitmap")
    return hits.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest")).where("least != greatest").select("digest")


def exact_duplicates(
    docs: DataFrame,
    *,
    keep: str = "smallest",
    batches: int = 4,
    fanout: int = 2,
    filter_bits: int = 1 << 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept."""
    with Scratch(docs.sparkSession, "lsm") as scratch:
        index = DigestIndex(docs.sparkSession, scratch, keep=keep, fanout=fanout, filter_bits=filter_bits)
        rows = _digested(docs, digest, id_col, text_col)
        runs = flush(rows, scratch, batches)
        for run in runs:
            index.add(run)
        repeated = scratch.table(index.compact_all().where("group_size > 1"), "repeated")
        collided = scratch.table(collisions(index, rows, repeated), "collisions")
        if not collided.isEmpty():
            return materialise(_by_text(index, rows, collided, scratch), "groups")
        flushed = reduce(DataFrame.unionByName, runs)
        probed = probe_bitmap(flushed, index.bit(), index.filter(repeated))
        entries = repeated.withColumn("rows", F.col("group_size"))
        found = spread_join(probed.where("in_bitmap").drop("in_bitmap"), entries, ["digest"], "rows", how="left")
        alone = probed.where(~F.col("in_bitmap")).select("doc_id", "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        found = found.select("doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(True)).alias("kept")).unionByName(alone)
        one = F.col("group_size").isNull()
        found = found.select("doc_id", "digest", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "kept")
        return materialise(found, "groups")


def _by_text(index: DigestIndex, rows: DataFrame, collided: DataFrame, scratch: Scratch) -> DataFrame:
    """The exact way beyond a digest collision: those rows' group key is the whole text."""
    marked = rows.join(collided.withColumn("collided", F.lit(True)), "digest", "left")
    whole = F.struct("digest", F.when(F.col("collided"), F.col("text")).alias("whole"))
    keyed = scratch.table(marked.select(whole.alias("digest"), "doc_id", F.monotonically_increasing_id().alias("row_no")), "whole-texts")
    entries = keyed.select("digest", F.col("doc_id").alias("keep_id"), F.col("row_no").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    groups = index._merged(entries)
    same = (F.col("r.digest.digest") == F.col("g.digest.digest")) & F.col("r.digest.whole").eqNullSafe(F.col("g.digest.whole"))
    found = keyed.alias("r").join(groups.alias("g"), same, "left")
    return found.select("r.doc_id", F.col("r.digest.digest").alias("digest"), "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"))
