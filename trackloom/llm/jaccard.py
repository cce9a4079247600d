"""Near-duplicates by exact Jaccard similarity of 5-word shingles: SimHash and its BK-trees first, MinHash bands for the rest.

Two texts are linked if their sets of ``shingle``-word shingles have a Jaccard similarity of at least 0.8. Texts of equal
set collapse first. Then fingerprints over the sets go through the BK-trees of :mod:`.simhash_bk`, which find most
copies: those of at most 3 differing bits. SimHash alone cannot decide 0.8: there fingerprints differ by 9.7 of 64 bits
in the mean, with a deviation of 2.9, and a radius that loses no pair (about 20 bits) leaves the pigeonhole no
block to go by. So what the trees have not joined yet meets in ``BANDS`` bands of ``ROWS`` MinHash minima: a pair at 0.8
shares no band with a probability of (1 - 0.8**5)**50 = 2.4e-9. Every candidate of either kind is judged by its whole
sets; sets are written once and only candidates' sets are shuffled.

A band of over ``MOST`` texts may be held together by a passage that all of them have and be far from 0.8, so that nothing
links and every pair would be compared. Its texts meet by their rarest shingles instead (:func:`rarest`), which
no pair at 0.8 can miss. Texts of a band or of a shingle are compared by :func:`.graph.band_links`, which leaves out no
pair unless both ends are connected already.

Defined results: texts of fewer words than a shingle are one shingle; null and empty texts have the empty set and
equal each other only; a null id is carried through; repeated rows are one node; very long texts are sketched whole, eight
bytes a shingle; columns other than id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash_bk
from .common import Scratch, bitmap, map_text, materialise, probe_bitmap, salted_join, spread_join
from .graph import band_links, connected_components
from .simhash_bk import majority_bits, shingle_hashes

BANDS, ROWS, SEED = 50, 5, 42
FILTER_BITS = 1 << 24
#: Pivots of a band in the first round.
PIVOTS = 16
#: Texts of a band, beyond which they meet by their rarest shingles.
MOST = 32

_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_START = _RNG.integers(0, 1 << 63, BANDS, np.uint64)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle, SEED))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 128):
        np.minimum(low, (hashes[at : at + 128, None] * _A + _B).min(axis=0), out=low)
    return ((low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _START).view(np.int64)


def _sketch(texts: list, shingle: int) -> dict:
    import xxhash

    sets = [shingles(t, shingle) for t in texts]
    return {
        "node": [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets],
        "n": [len(s) for s in sets],
        "fp": [majority_bits(s) for s in sets],
        "keys": [band_keys(s) if len(s) else [] for s in sets],
        "hashes": [s.view(np.int64) for s in sets],
    }


def _bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _tree_pairs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or linked: a spanning forest of them."""
    prints = scratch.table(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("held")), "prints")
    equal = spread_join(nodes.select("node", "fp"), prints, ["fp"], "held").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = simhash_bk.links(prints.select("fp"), scratch).distinct()
    for c in "ab":
        linked = linked.join(prints.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node")), c)
    return equal.unionByName(linked.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def rarest(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, n, at): shingles by which every pair of ``sets`` (node, hashes) at 0.8 meets; ``at`` counts the rarer ones of a node.

    All sets are sorted by one order, rare shingles first. A pair at 0.8 has four fifths of either set in common, so its first
    common shingle is among the n - ceil(0.8 n) + 1 first ones of both, and what follows it holds all others. Where that is
    too little even for the smallest set that has the shingle, the row goes.
    """
    words = scratch.table(sets.select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("key")), "words")
    counts = scratch.table(words.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "counts")
    order = Window.partitionBy("node").orderBy(F.coalesce("held", F.lit(1)), "key")
    ranked = spread_join(words, counts, ["key"], "held", how="left").withColumn("at", F.row_number().over(order) - 1)
    first = scratch.table(ranked.where("held > 1 and at <= n - (4 * n + 4) div 5").select("key", "node", "n", "at"), "first")
    shared = scratch.table(first.groupBy("key").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("held")).where("held > 1"), "shared")
    met = spread_join(first, shared, ["key"], "held").where("9 * (n - at) >= 4 * (n + least)")
    return scratch.table(met.select("key", "node", "n", "at"), "rarest")


def links(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links; sketches: (node, n, fp, keys, hashes)."""
    nodes = scratch.table(sketches.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "keys")]), "nodes")
    pairs = scratch.table(_tree_pairs(nodes, scratch), "tree-pairs")
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = scratch.table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shared")
    bands = scratch.table(spread_join(rows, shared, ["key"], "held").select("key", "node", "n", F.lit(0).alias("at"), "held"), "bands")
    asked = bands.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    probed = probe_bitmap(sketches.select("node", "hashes"), _bit("node"), bitmap(asked, _bit("node")))
    sets = scratch.table(probed.where("in_bitmap").groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs
        for c in "ab":
            both = salted_join(both, sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set")), c, scratch)
        both = both.withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
        # common / (|a| + |b| - common) >= 4 / 5, in whole numbers
        return both.where(9 * F.col("common") >= 4 * (F.size("a_set") + F.size("b_set"))).select("a", "b")

    known = scratch.table(near(pairs), "known")
    crowded = bitmap(bands.where(F.col("held") > MOST).select("node"), _bit("node"))
    met = bands.where(F.col("held") <= MOST).drop("held")
    if not crowded.isEmpty():
        met = met.unionByName(rarest(probe_bitmap(sets, _bit("node"), crowded).where("in_bitmap").drop("in_bitmap"), scratch))
    return band_links(met, known, near, scratch, where="9 * least(n - at, p_n - p_at) >= 4 * (n + p_n)", pivots=PIVOTS)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, text_hash, component), one row per input row; ``component`` names a group of near-duplicates."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    made = map_text(rows, lambda: lambda texts: _sketch(texts, shingle), "node long, n int, fp long, keys array<long>, hashes array<long>")
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        sketches = scratch.table(made.drop("text"), "sketches")
        parts = connected_components(links(sketches, scratch), into=scratch)
        sized = sketches.groupBy("node").agg(F.count(F.lit(1)).alias("held")).join(parts, "node", "left")
        sized = scratch.table(sized.select("node", "held", F.coalesce("component", "node").alias("component")), "components")
        named = spread_join(sketches.select("doc_id", "text_hash", "node"), sized, ["node"], "held")
        return materialise(named.select("doc_id", "text_hash", "component"), "near-duplicates")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that of the smallest (id, text hash), those without an id last.

    Rows of equal id and text are one document. Only rows that a bitmap of fixed size lets through (dropped or
    repeated ones, and few others) are shuffled; all others stay where they are.
    """
    spark = docs.sparkSession
    doc = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).alias("doc")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col).select(doc, "component")
    different = found.groupBy("doc", "component").agg(F.count(F.lit(1)).alias("held"))
    with Scratch(spark, "near-drops") as scratch:
        different = scratch.table(different, "different")
        first = F.min(F.struct(F.col("doc.id").isNull().alias("unnamed"), "doc")).alias("first")
        groups = scratch.table(different.groupBy("component").agg(first, F.count(F.lit(1)).alias("members")), "groups")
        judged = spread_join(different, groups, ["component"], "members").withColumn("stays", F.col("doc") == F.col("first.doc"))
        touched = materialise(judged.where("not stays or held > 1").select("doc", "stays", "held"), "near-drops")
    bit = F.pmod(F.xxhash64("__doc"), F.lit(FILTER_BITS))
    rows = docs.withColumn("__doc", F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h")))
    probed = probe_bitmap(rows, bit, bitmap(touched.withColumnRenamed("doc", "__doc"), bit))
    status = touched.select(F.col("doc").alias("__doc"), F.col("stays").alias("__stays"), F.col("held").alias("__held"))
    near = spread_join(probed.where("in_bitmap").drop("in_bitmap"), status, ["__doc"], "__held", how="left")
    # what is not in ``status`` came through the bitmap by chance and stands once
    once = near.where("__stays is null or __stays").dropDuplicates(["__doc"]).select(docs.columns)
    return probed.where(~F.col("in_bitmap")).select(docs.columns).unionByName(once)
