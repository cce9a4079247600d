"""What the line tree spends: each line is normalised once, a bitmap is probed by words, small parts are judged whole."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.llm import line_templates as lt
from trackloom.llm.common import bitmap, probe_bitmap

from .helpers import AWKWARD, documents
from .test_lines_and_leaks import corpus, slow_repeats


def test_a_line_is_normalised_once(spark):
    plan = lt._lines(documents(spark, AWKWARD), 3, 5, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\S*[0-9]\S*") == 1


def test_blank_lines_go_and_odd_ones_are_normalised(spark):
    raw = ["", " ", "\t \x0b\f\r", " ", "  a \t b\x0b\fc\r", "a b", " a b ", "a  b", "x1  y", "1", "a 9", "\x1f", "é é"]
    got = lt._lines(documents(spark, [(1, "\n".join(raw))]), 3, 1, "doc_id", "text").collect()
    want = {3: " ", 4: "a b c", 5: "a b", 6: "a b", 7: "a b", 8: "<*> y", 9: "<*>", 10: "<*>", 11: "\x1f", 12: "é é"}
    assert {r["pos"]: r["text"] for r in got} == want


@pytest.mark.parametrize("few", [1, 3, 32])
def test_small_and_large_parts_are_judged_alike(spark, monkeypatch, few):
    """``few``: parts above it are judged by blocks of two lines, all others in one row each."""
    monkeypatch.setattr(lt, "FEW", few)
    monkeypatch.setattr(lt, "BLOCK", 2)
    rng = random.Random(few)
    words = [f"w{chr(97 + k)}" for k in range(4)]
    made = [(d, " ".join(["one", "two", rng.choice(words)] + [rng.choice(words[: rng.choice((1, 2, 4))]) for _ in range(rng.choice((2, 5, 8)))])) for d in range(1000, 1300)]
    rows = corpus() + made
    got = lt.drop_repeated_lines(documents(spark, rows), counts=("n", "dropped")).where("dropped > 0").collect()
    assert {r["doc_id"]: r["dropped"] for r in got} == {d: len(x) for d, x in slow_repeats(rows).items()}


def test_a_bitmap_holds_each_of_its_bits(spark):
    bits = [*range(0, 200, 3), 32766, 32767, 32768, 32769, 70000]
    words = bitmap(spark.createDataFrame([(b,) for b in bits], "b long"), F.col("b"))
    probed = probe_bitmap(spark.range(75_000).unionByName(spark.createDataFrame([(None,)], "id long")), F.col("id"), words)
    assert sorted(r["id"] for r in probed.where("in_bitmap").collect()) == bits
    assert probed.count() == 75_001
