import hashlib
import os

import pytest
from pyspark.sql import functions as F

from trackloom.functions.tables import Scratch, work_root
from trackloom.llm import lsm_dedup

from .helpers import AWKWARD, documents

ROWS = [*AWKWARD, *((100 + i, f"text {i % 7}") for i in range(50)), *((None, "text 3") for _ in range(2)), (-(2**63), "text 1"), (2**63 - 1, "text 2")]


def expected(rows, keep):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(t or "", []).append(d)
    pick = max if keep == "largest" else min
    out = []
    for d, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((d, pick(ids) if ids else None, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("bits", [256, 2])
def test_groups_equal_texts(spark, keep, bits):
    # two bits of digest force collisions, so the whole texts decide
    digest = lsm_dedup.sha256 if bits == 256 else lambda t: F.unhex(F.concat(F.lit("0"), F.hex(F.pmod(F.xxhash64(t), F.lit(4)))))
    docs = documents(spark, ROWS, extra=True)
    got = lsm_dedup.exact_duplicates(docs, keep=keep, digest=digest).collect()
    want, groups = expected(ROWS, keep)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == sorted(((a, b, c) for a, b, c, _ in want), key=str)
    assert sum(r["kept"] for r in got) == groups
    assert all(r["keep_id"] == r["doc_id"] for r in got if r["kept"])


def test_digest_is_the_texts_sha256(spark):
    got = lsm_dedup.exact_duplicates(documents(spark, ROWS), keep="largest").select("doc_id", F.lower(F.hex("digest")).alias("d")).collect()
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted(((a, d) for a, _, _, d in expected(ROWS, "largest")[0]), key=str)


def test_empty_table_and_wrong_option(spark):
    assert lsm_dedup.exact_duplicates(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        lsm_dedup.exact_duplicates(documents(spark, []), keep="any")


def test_batches_merge_through_levels(spark):
    """Five batches: two merges to level 1, one to level 2; lookups go through filters of runs on two levels."""
    batches = [[("a", 5, 50), ("b", 1, 10)], [("a", 3, 30)], [("a", 4, 40), ("c", 9, 90)], [("d", 7, 70)], [("b", 2, 20), ("e", None, 99)]]
    frames = [spark.createDataFrame([(d.encode(), i, r) for d, i, r in b], "digest binary, doc_id long, row_no long") for b in batches]
    with Scratch(spark, "test") as scratch:
        index = lsm_dedup.DigestIndex(spark, scratch)
        shapes = []
        for frame in frames:
            index.add(frame)
            shapes.append([len(level) for level in index.levels])
        assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
        wanted = spark.createDataFrame([(x.encode(),) for x in "abezz"], "digest binary")
        got = {bytes(r["digest"]).decode(): (r["keep_id"], r["keep_row"], r["group_size"]) for r in index.lookup(wanted).collect()}
        assert got == {"a": (3, 30, 3), "b": (1, 10, 2), "e": (None, 99, 1)}
        assert index.compact_all().count() == 5 and [len(level) for level in index.levels] == [1]
        assert lsm_dedup.DigestIndex(spark, scratch).lookup(wanted).count() == 0


def test_scratch_tables_go(spark):
    root = work_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    assert lsm_dedup.exact_duplicates(documents(spark, ROWS)).count() == len(ROWS)
    assert [x.split("-")[1] for x in set(os.listdir(root)) - before] == ["groups"]
