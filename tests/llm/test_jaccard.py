import random

import corpus_pipeline as cp

from trackloom.llm import jaccard

from .helpers import documents
from .test_simhash import components


def slow_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def near_copies():
    """Groups of copies with one to nine words changed of a hundred, similarities on both sides of 0.8."""
    rng = random.Random(11)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(6):
            copy = base[:]
            for at in rng.sample(range(100), rng.randrange(1, 5)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, f"{w} words") for k, w in enumerate(("few", "FEW", "other"))]
    return rows


def groups(rows):
    sets = {d: slow_set(t) for d, t in rows}
    ids = list(sets)
    near = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    return components([(a, b) for i, a in enumerate(ids) for b in ids[:i] if near(a, b)], ids)


def test_stage_finds_every_pair_at_four_fifths(spark):
    rows = near_copies()
    kept = {r["doc_id"] for r in cp.near_duplicate_stage(spark, documents(spark, rows), "").collect()}
    assert kept == set(groups(rows).values()) and 25 < len(kept) < len(rows)


def test_few_pivots_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    rows = near_copies()[:60]
    got, want = {}, {}
    for r in jaccard.near_duplicates(documents(spark, rows)).collect():
        got.setdefault(r["component"], set()).add(r["doc_id"])
    for d, c in groups(rows).items():
        want.setdefault(c, set()).add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_repeated_and_null_ids_lose_no_text(spark):
    say = lambda w: " ".join(f"{w}{k}" for k in range(30))
    rows = [(1, say("a")), (1, say("b")), (1, say("a")), (2, say("b")), (None, say("c")), (None, say("c")), (None, say("a"))]
    got = [(r["doc_id"], r["text"]) for r in cp.near_duplicate_stage(spark, documents(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([(1, say("a")), (1, say("b")), (None, say("c"))], key=str)


def shared_passage(n):
    """Texts of 80 words that all have in common and 20 of their own, similarity 0.66 to each other; every tenth has a near copy."""
    common = [f"c{k}" for k in range(80)]
    texts = [common + [f"o{i}x{k}" for k in range(20)] for i in range(n)]
    texts += [t[:-1] + ["end"] for t in texts[::10]]
    return [(d, " ".join(t)) for d, t in enumerate(texts)]


def compared(spark, monkeypatch, rows):
    """Pairs of texts that the bands compare, and the groups found."""
    seen, plain = [], jaccard.band_links

    def counted(bands, known, near, scratch, **more):
        def ask(pairs):
            seen.append(pairs.count())
            return near(pairs)

        return plain(bands, known, ask, scratch, **more)

    monkeypatch.setattr(jaccard, "band_links", counted)
    got = {}
    for r in jaccard.near_duplicates(documents(spark, rows)).collect():
        got.setdefault(r["component"], set()).add(r["doc_id"])
    return sum(seen), sorted(map(sorted, got.values()))


def as_groups(rows):
    want = {}
    for d, c in groups(rows).items():
        want.setdefault(c, set()).add(d)
    return sorted(map(sorted, want.values()))


def test_a_passage_in_all_texts_compares_few_pairs(spark, monkeypatch):
    rows = shared_passage(200)
    pairs, found = compared(spark, monkeypatch, rows)
    assert found == as_groups(rows) and len(found) == 200
    # small bands still compare all of theirs
    assert pairs < len(rows) * (len(rows) - 1) // 2 // 4


def test_rarest_shingles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST", 1)
    rows = near_copies()[:60] + [(1000 + d, t) for d, t in shared_passage(20)]
    assert compared(spark, monkeypatch, rows)[1] == as_groups(rows)
