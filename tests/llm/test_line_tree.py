import random

import pytest

from trackloom.llm import line_templates as lt

from .helpers import documents
from .test_lines_and_leaks import slow_repeats


def kept(spark, rows):
    return {r["doc_id"]: r["text"] for r in lt.drop_repeated_lines(documents(spark, rows)).collect()}


@pytest.mark.parametrize("names, cities", [(10, 1), (10, 10), (100, 100)])
def test_a_template_of_two_fields_collapses_at_any_size(spark, names, cities):
    """``names`` x ``cities`` lines; with one city each name has its own."""
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    pairs = [(n, c if cities > 1 else n) for n in range(names) for c in range(cities)]
    rows = [(k, f"This page was written by N{word(n)} for the C{word(c)} office") for k, (n, c) in enumerate(pairs)]
    assert [d for d, t in kept(spark, rows).items() if t] == [0]


def test_mixed_leaves_are_split(spark):
    """Three templates with the same leading tokens, none of which has a majority."""
    forms = ["all of the red {} lie on the table now my friend", "all of the old {} were sold to a man from there", "all of the news {} can be read below by any one"]
    rows = [(k, forms[k % 3].format(f"w{chr(97 + k)}")) for k in range(15)]
    assert [d for d, t in kept(spark, rows).items() if t] == [0, 1, 2]


def test_the_tree_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + k)}" for k in range(4)]
    rows = [(d, " ".join(["one", "two", "three"] + [rng.choice(words[: rng.choice((1, 2, 4))]) for _ in range(rng.choice((2, 5, 8)))])) for d in range(300)]
    for splits in (0, 1, 2, 3):
        want = slow_repeats(rows, splits=splits)
        got = lt.drop_repeated_lines(documents(spark, rows), splits=splits, counts=("n", "dropped")).where("dropped > 0").collect()
        assert {r["doc_id"]: r["dropped"] for r in got} == {d: len(x) for d, x in want.items()}


def test_short_lines_recur_by_their_own_text(spark):
    han = "本网站所有内容均受版权保护未经许可不得转载或使用第{}版"
    lines = ["Les.", "All rights reserved.", "Page {} of 20", han, "", "7{}", "x"]
    rows = [(d, "\n".join(x.format(d) for x in lines) + f"\nown{chr(97 + d)}") for d in range(4)]
    assert kept(spark, rows) == {d: t if d == 0 else f"\n7{d}\nown{chr(97 + d)}" for d, t in rows}


def test_clashing_count_columns_give_way(spark):
    docs = documents(spark, [(1, "a b c d e\nf"), (2, "a b c d e\nf"), (3, "x" * 100_000 + "\n" * 100_000 + "f")]).selectExpr("*", "'other' as n_lines")
    got = lt.drop_repeated_lines(docs, counts=("n_lines", "n_dropped"))
    assert got.columns == [*docs.columns[:-1], "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == [(1, 2, 0), (2, 2, 2), (3, 100_001, 1)]
