"""SimHash near-duplicates, linked through BK-trees.

Fingerprints: 64 bits over word shingles, XXH64 with seed 42. Documents of equal
fingerprint collapse first, so a group of copies counts once.

Links within ``radius`` bits: of four 16-bit blocks one is equal in any linked pair (pigeonhole), so every fingerprint is
dealt to four shards, named by the leading bits of its blocks, as many of them as give a shard ``TREE`` fingerprints in
the mean. Where even whole blocks leave more than that, or one shard holds over ``MOST``, the key takes in leading
bits of one of the four 12-bit parts of the other 48 bits, of which one is equal too. A linked pair thus meets in one
shard at least at every size, and memory is one shard's tree.

Each shard grows a BK-tree: a child hangs on its parent by their Hamming distance d, and a search follows only edges in
[d - radius, d + radius]. Every fingerprint is searched in the trees of its shards and then hung into them; a shard yields a
spanning forest of its links, not all pairs. The trees stay in the tasks that hold their shards' rows instead of being
broadcast: together they hold every fingerprint, which has no size bound and must not pass through the driver.

Defined results: null and empty texts have fingerprint zero and link like any other; very long texts are hashed whole, in
memory that is a multiple of their length; repeated rows link to each other; ids keep their type, and null ids never name
a component unless all its ids are null; columns other than id and text are not read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, map_text, materialise, spread_join
from .graph import connected_components


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle in order, repeats included; fewer words than a shingle are one shingle."""
    import xxhash

    # bytes: lower() turns A-Z alone and split() knows just space and \x09-\x0d
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    grams = words if shingle == 1 else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, len(words) - shingle + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number; zero where there is none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint as a signed 64-bit number."""
    return majority_bits(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = map_text(rows, lambda: lambda texts: {"fp": [simhash(t, shingle, seed) for t in texts]}, "fp long")
    return made.select("doc_id", "fp")


#: Fingerprints of a shard in the mean, and from how many on a shard is dealt anew by longer keys.
TREE, MOST = 256, 1 << 14


def key_bits(n: int) -> tuple[int, int]:
    """Leading bits of a block, and of a part, that name a shard of n different fingerprints."""
    bits = max((n // TREE).bit_length() - 1, 0)
    return min(bits, 16), min(max(bits - 16, 0), 12)


def block_keys(fp: Column, bits: int) -> list[Column]:
    """The four shards (block number, its leading bits)."""
    block = lambda b: F.shiftrightunsigned(fp, 16 * b).bitwiseAND(0xFFFF)
    return [F.shiftleft(F.lit(b).cast("long"), 32).bitwiseOR(F.shiftright(block(b), 16 - bits)) for b in range(4)]


def part_keys(fp: Column, b: int, bits: int) -> Column:
    """The four shards (block number, whole block, part number, its leading bits) that block ``b`` leads to."""
    block = F.shiftrightunsigned(fp, 16 * b).bitwiseAND(0xFFFF)
    low = fp.bitwiseAND((1 << 16 * b) - 1)
    high = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(fp, 16 * b), 16), 16 * b)
    rest = low.bitwiseOR(high)
    keys = []
    for p in range(4):
        part = F.shiftright(F.shiftrightunsigned(rest, 12 * p).bitwiseAND(0xFFF), 12 - bits)
        keys.append(F.shiftleft(F.lit(4 + b * 4 + p).cast("long"), 32).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


class BKTree:
    """Burkhard-Keller tree over 64-bit fingerprints with Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            edge = (self.values[at] ^ value).bit_count()
            following = self.children[at].get(edge)
            if following is None:
                self.children[at][edge] = new
                return
            at = following

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most ``radius`` bits away."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = children[at]
            if len(kids) <= 2 * radius + 1:
                todo.extend(c for edge, c in kids.items() if d - radius <= edge <= d + radius)
            else:
                todo.extend(kids[edge] for edge in range(d - radius, d + radius + 1) if edge in kids)
        return found


def shard_forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one shard (values differ from each other)."""
    tree, parent, edges = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for new, value in enumerate(values):
        for old in tree.within(value, radius):
            if (r := root(old)) != root(new):
                parent[root(new)] = r
                edges.append((new, old))
        tree.add(value)
    return edges


def _link(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by key; the last key of a batch waits for the next one."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def close(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        a, b = [], []
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
            if e - s > 1:
                for i, j in shard_forest([int(x) for x in fps[s:e].view(np.uint64)], radius):
                    a.append(fps[s + i])
                    b.append(fps[s + j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = np.r_[keys, batch.column(0).to_numpy()], np.r_[fps, batch.column(1).to_numpy()]
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield close(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield close(keys, fps)


def shards(distinct: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(key, fp): every different fingerprint in each of its shards."""
    bits, more = key_bits(distinct.count())
    fp = F.col("fp")
    if more:
        return distinct.select(F.explode(F.concat(*[part_keys(fp, b, more) for b in range(4)])).alias("key"), "fp")
    dealt = distinct.select(F.explode(F.array(*block_keys(fp, bits))).alias("key"), "fp")
    large = scratch.table(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most), "large-shards")
    if large.isEmpty():
        return dealt
    met = spread_join(scratch.table(dealt, "dealt"), large, ["key"], "held", how="left")
    by_block = F.element_at(F.array(*[part_keys(fp, b, 12) for b in range(4)]), F.shiftright("key", 32).cast("int") + 1)
    return met.where("held is null").select("key", "fp").unionByName(met.where("held is not null").select(F.explode(by_block).alias("key"), "fp"))


def links(distinct: DataFrame, scratch: Scratch, radius: int = 3, most: int = MOST) -> DataFrame:
    """Edges (a, b) between different fingerprints that span all links of at most ``radius`` bits."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks hold an equal one only up to a radius of 3")
    dealt = shards(distinct, scratch, most).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return map_batches(dealt, lambda it: _link(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, *, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row."""
    with Scratch(docs.sparkSession, "simhash") as scratch:
        fps = scratch.table(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
        groups = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("held")), "groups")
        parts = connected_components(links(groups.select("fp"), scratch, radius), into=scratch)
        linked = scratch.table(parts.join(groups, parts["node"] == groups["fp"]).select("fp", "component", "least"), "linked")
        least = scratch.table(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "least")
        named = spread_join(linked.select("fp", "component"), least, ["component"], "nodes").select("fp", "component_id")
        label = groups.join(named, "fp", "left").select("fp", "held", F.coalesce("component_id", "least").alias("component_id"))
        found = spread_join(fps, scratch.table(label, "labels"), ["fp"], "held")
        return materialise(found.select("doc_id", "fp", "component_id"), "near-duplicates")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
