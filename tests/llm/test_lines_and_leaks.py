import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import decontamination as dc
from trackloom.llm import line_templates as lt

from .helpers import AWKWARD, documents


def slow_templates(group, similarity, splits, name):
    """line -> template of the different lines that reached one place of the tree; ``name`` is that place."""
    if len(group) < 2:
        return {}
    columns = [Counter(t[i] for t in group) for i in range(len(group[0]))]
    constant = [next((x for x, c in col.items() if 2 * c > len(group)), None) for col in columns]
    takes = {t for t in group if sum(x == c for x, c in zip(t, constant)) >= similarity * len(t)}  # noqa: B905
    found = dict.fromkeys(takes, name)
    if splits and len(takes) < len(group):
        _, cut = min((len(col), i) for i, col in enumerate(columns) if len(col) > 1)
        parts = {}
        for t in group:
            if t not in takes:
                parts.setdefault(t[cut], []).append(t)
        for token, part in parts.items():
            found |= slow_templates(part, similarity, splits - 1, (*name, token))
    return found


def slow_repeats(rows, depth=3, least=5, similarity=0.8, splits=2):
    """(id, text) -> dropped positions, by the docstring's words. Ids are unique here."""
    lines = []
    for d, t in rows:
        for pos, raw in enumerate((t or "").split("\n")):
            exact = re.sub(r"[ \t\r\f\v]+", " ", raw).strip(" ")
            masked = re.sub(r"\S*[0-9]\S*", "<*>", exact)
            tokens = tuple(masked.split(" "))
            if len(tokens) < least and not any(c.isalpha() for c in masked):
                tokens = (re.sub("[0-9]+", "<*>", exact) if any(c.isalpha() for c in exact) and len(exact) >= 20 else exact,)
            if masked:
                lines.append((d, pos, tokens))
    leaves, templates = {}, {}
    for t in {t for _, _, t in lines if len(t) >= least}:
        leaves.setdefault((len(t), t[:depth]), []).append(t)
    for name, group in leaves.items():
        templates |= slow_templates(group, similarity, splits, ("tree", *name))
    docs = {}
    for d, _, t in lines:
        docs.setdefault(templates.get(t, t), set()).add(d)
    drops = {}
    for d, pos, t in lines:
        if len(seen := docs[templates.get(t, t)]) > 1 and d != min(seen, key=lambda x: (x is not None, x)):
            drops.setdefault(d, []).append(pos)
    return drops


def corpus():
    rng = random.Random(5)
    words = "red blue green gold grey pink".split()
    rows = []
    for d in range(60):
        lines = [f"user {rng.randrange(9)} logged in from host {rng.choice(words)} at {d}:0{d % 10}"]
        lines += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for _ in range(4)]
        lines += ["All of this is licensed under the terms below", "short line"] if d % 2 else ["", "  "]
        rows.append((d, "\n".join(lines)))
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (None, "All of this is licensed under the terms below\nmine alone it is here")]


def test_repeated_templates_are_dropped(spark):
    rows = corpus()
    want = slow_repeats(rows)
    got = lt.drop_repeated_lines(documents(spark, rows, extra=True), counts=("n_lines", "n_dropped")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        drops = want.get(r["doc_id"], [])
        text = texts[r["doc_id"]]
        assert r["n_dropped"] == len(drops)
        assert r["text"] == (text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drops))
        assert r["score"] == "other"


def test_a_repeated_row_is_one_document(spark):
    line = "this line stands in one document twice over"
    got = lt.drop_repeated_lines(documents(spark, [(1, line), (1, line), (2, line), (3, line * 3000)])).collect()
    assert sorted((r["doc_id"], r["text"] != "") for r in got) == [(1, True), (1, True), (2, False), (3, True)]
    assert lt.drop_repeated_lines(documents(spark, [])).count() == 0


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, c in enumerate(text, 1):
            row[j] = min(last[j - 1] + (p != c), last[j] + 1, row[j - 1] + 1)
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=80), st.text(alphabet="abc ", max_size=120))
def test_myers_distance(pattern, text):
    assert dc.myers(dc.pattern_masks(pattern), len(pattern), text)[0] == slow_distance(pattern, text)


def test_edited_items_are_found(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    say = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(n))
    items = [(i, say(30).capitalize() + ".") for i in range(12)] + [(50, None), (51, ""), (52, "...!")]
    rows, texts = list(AWKWARD), [t for _, t in items[:12]]
    for k in range(120):
        t = list(texts[k % 12])
        for _ in range(k // 6):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice(["", "q", "zz"])
        rows.append((1000 + k, say(20) + "\n" + "".join(t).upper() * (k % 5 > 0) + " " + say(20)))
    docs = documents(spark, rows, extra=True)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, item in items:
            p = dc.normalise(item)
            if p and len(t or "") < 5000 and (x := slow_distance(p, dc.normalise(t))) <= dc.budget(len(p), 0.08):
                want.add((d, i, x))
    assert len(want) > 40
    for chars in (4_000_000, 600):
        assert {tuple(r) for r in dc.find_contamination(docs, bench, block_chars=chars).collect()} == want
    clean = dc.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in {w[0] for w in want})


def test_every_item_length_keeps_its_budget(spark):
    """Items of 10 to 400 characters, found at 8 % of edits and not beyond; every pair by Myers' distance over the whole text."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    say = lambda n: "".join(rng.choice(letters + "  ") for _ in range(3 * n))
    items = [(i, dc.normalise(say(n + 5))[:n].strip()) for i, n in enumerate((10, 12, 13, 18, 24, 25, 30, 37, 38, 60, 100, 200, 400))]
    rows = []
    for i, item in items:
        e = int(0.08 * len(item))
        for k in range(6):
            t = list(item)
            for at in rng.sample(range(len(t)), min(e + k % 2, len(t))):
                t[at] = rng.choice(["#", "", "qx"][: 1 + k]).replace("#", rng.choice("0123456789"))
            rows.append((100 * i + k, say(10) + " " + "".join(t) + " " + say(10)))
    want = set()
    for d, t in rows:
        for i, item in items:
            x = dc.myers(dc.pattern_masks(item), len(item), dc.normalise(t))[0]
            if x <= int(0.08 * len(item)):
                want.add((d, i, x))
    bench = spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    assert {(d, int(i), x) for d, i, x in dc.find_contamination(documents(spark, rows), bench).collect()} == want
    assert {i for _, i, x in want if x} >= set(range(2, len(items)))


@pytest.mark.parametrize("side", ["docs", "benchmark"])
def test_empty_sides(spark, side):
    docs = documents(spark, [] if side == "docs" else AWKWARD)
    bench = spark.createDataFrame([] if side == "benchmark" else [(1, "some test item")], "item_id long, text string")
    assert dc.find_contamination(docs, bench).count() == 0
    assert dc.drop_contaminated(docs, bench).count() == docs.count()
