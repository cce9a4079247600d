"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins over the remaining edges, written to the shared
folder; the edge set shrinks to stars. A centre that holds a large share of all edges is a skewed side of an inner join, which
adaptive execution splits. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, spread_join


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """pairs (u, v): every v (that is larger than u, if asked) points at u's smallest neighbour, itself included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if larger_only:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, into: Scratch | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge. Null ends are ignored.

    The result is a table of ``into``, or of the shared folder.
    """
    cut = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} is not null and {b} is not null and a != b").distinct()
    with Scratch(edges.sparkSession, "components") as scratch:
        now = scratch.table(cut, "edges")
        seen = _mark(now)
        while seen[0]:
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
            large = _star(both, larger_only=True)
            now = scratch.table(_star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), larger_only=False), "edges")
            if (mark := _mark(now)) == seen:
                break
            seen = mark
        roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
        found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        return into.table(found, "components") if into else materialise(found, "components")


def band_links(bands: DataFrame, known: DataFrame, near: Callable[[DataFrame], DataFrame], scratch: Scratch, *, where: str = "true", pivots: int = 16) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of the ``known`` edges and of all near pairs that share a band.

    bands: (key, node, n, at), one row per band and node; ``near`` keeps the linked ones of pairs (a, b), and pairs that
    fail ``where`` (over n, at, p_n and p_at) are not asked about. A band's nodes meet ``pivots`` of their own at a time, those of
    its smallest components first, and only while it holds several components: a group of n linked nodes
    takes a small multiple of n comparisons. Each further round takes four times as many pivots. Nodes of a band that do not
    link are all compared, so the caller keeps such bands small.

    A band that holds a large share of all rows stays spread: its counts are aggregates, its pivots the first of those
    that each task finds, and they come to its rows by broadcast.
    """

    def placed(rows: DataFrame) -> DataFrame:
        parts = connected_components(edges, into=scratch)
        return scratch.table(rows.join(parts, "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("component")), "bands")

    edges = known
    bands = placed(bands)
    while True:
        sizes = scratch.table(bands.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size")), "sizes")
        keys = scratch.table(sizes.groupBy("key").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"), "keys")
        if keys.isEmpty():
            return edges
        several = scratch.table(spread_join(bands, keys, ["key"], "held").drop("held"), "several")
        sized = scratch.table(spread_join(several, sizes, ["key", "component"], "size").withColumn("task", F.spark_partition_id()), "sized")
        in_task = sized.withColumn("rank", F.row_number().over(Window.partitionBy("key", "task").orderBy("size", "node"))).where(F.col("rank") <= pivots)
        ranked = in_task.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("size", "node"))).where(F.col("rank") <= pivots)
        chosen = ranked.groupBy("key").agg(F.collect_list(F.struct("node", "n", "at", "component", "rank")).alias("pivots"))
        met = scratch.table(spread_join(several, scratch.table(chosen.join(keys, "key"), "pivots"), ["key"], "held"), "met")
        p, own = F.col("p"), F.array_position(F.transform("pivots", lambda x: x["node"]), F.col("node")).cast("int")
        # a pivot meets those before it, so each pair of pivots is met once
        ahead = F.slice("pivots", F.lit(1), F.when(own > 0, own - 1).otherwise(F.size("pivots")))
        one = met.select("node", "n", "at", "component", F.explode(ahead).alias("p"))
        one = one.select("node", "n", "at", "component", *[p[c].alias(f"p_{c}") for c in ("node", "n", "at", "component")])
        pairs = one.where(f"component != p_component and {where}").select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
        edges = scratch.table(edges.unionByName(near(scratch.table(pairs, "pairs"))), "edges")
        bands = placed(met.where(~F.exists("pivots", lambda x: x["node"] == F.col("node"))).select("key", "node", "n", "at"))
        pivots *= 4
