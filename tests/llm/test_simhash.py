import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import graph
from trackloom.llm import simhash_bk as sb
from trackloom.llm.common import Scratch

from .helpers import AWKWARD, documents


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    assert sb.simhash(text) % (1 << 64) == slow_fingerprint(text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 255), unique=True, max_size=60), st.integers(0, 3))
def test_bk_tree_finds_all_within_the_radius(values, radius):
    tree = sb.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:10]:
        assert sorted(tree.values[i] for i in tree.within(v, radius)) == sorted(x for x in values if (x ^ v).bit_count() <= radius)


def test_links_lose_no_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base[:20]:
        for _ in range(12):
            b ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4)))
            values.add(b % (1 << 64))
    values = sorted(values | {0, (1 << 64) - 1})
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    nodes = list(signed.values())
    want = components([(signed[a], signed[b]) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3], nodes)
    frame = spark.createDataFrame([(signed[v],) for v in values], "fp long")
    for most in (1 << 14, 40, 1):
        with Scratch(spark, "test") as scratch:
            edges = sb.links(frame, scratch, most=most).collect()
        assert components([(r["a"], r["b"]) for r in edges], nodes) == want
        assert len(edges) <= 20 * len(values)


@pytest.mark.parametrize("tree", [1, 16])
def test_longer_keys_lose_no_pair(spark, monkeypatch, tree):
    """Shards of a few fingerprints each, as if there were billions: keys of blocks and parts."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = sorted({(b ^ sum(1 << at for at in rng.sample(range(64), k))) - (1 << 63) for b in base for k in range(5)})
    monkeypatch.setattr(sb, "key_bits", lambda n: (16, 12 // tree))
    with Scratch(spark, "test") as scratch:
        edges = sb.links(spark.createDataFrame([(v,) for v in values], "fp long"), scratch).collect()
    bits = {v: v % (1 << 64) for v in values}
    want = components([(a, b) for i, a in enumerate(values) for b in values[:i] if (bits[a] ^ bits[b]).bit_count() <= 3], values)
    assert components([(r["a"], r["b"]) for r in edges], values) == want


def test_trees_do_the_searching(spark):
    """Shards hold many fingerprints whatever their number, and a search reads a part of its tree."""
    assert sb.key_bits(100) == (0, 0) and sb.key_bits(20_000) == (6, 0) and sb.key_bits(1 << 40) == (16, 12)
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(20_000)]
    frame = spark.createDataFrame([(v - (1 << 63),) for v in values], "fp long")
    with Scratch(spark, "test") as scratch:
        sizes = [r["count"] for r in sb.shards(frame, scratch).groupBy("key").count().collect()]
    assert sum(sizes) == 4 * len(values) and min(sizes) > 200
    tree = sb.BKTree()
    for v in values[:300]:
        tree.add(v)
    visited = []
    for v in values[:100]:
        seen = 0
        todo = [0]
        while todo:
            at = todo.pop()
            seen += 1
            d = (tree.values[at] ^ v).bit_count()
            todo += [c for e, c in tree.children[at].items() if abs(e - d) <= 3]
        visited.append(seen)
    assert sum(visited) / len(visited) < 0.6 * 300


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components(pairs, sorted({x for p in pairs for x in p}))
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_end_to_end(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [*AWKWARD]
    for k in range(30):
        copy = words[:]
        copy[k * 7] = "changed"
        rows.append((200 + k, " ".join(copy)))
    rows.append((199, " ".join(words)))
    got = sb.near_duplicates(documents(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    fps = {}
    for d, t in rows:
        fps.setdefault(slow_fingerprint(t), []).append(d)
    keys = list(fps)
    parts = components([(a, b) for i, a in enumerate(keys) for b in keys[:i] if (a ^ b).bit_count() <= 3], keys)
    least = {}
    for f, ids in fps.items():
        least.setdefault(parts[f], []).extend(i for i in ids if i is not None)
    for r in got:
        ids = least[parts[r["fp"] % (1 << 64)]]
        assert r["component_id"] == (min(ids) if ids else None)
    assert sb.near_duplicates(documents(spark, [])).count() == 0
