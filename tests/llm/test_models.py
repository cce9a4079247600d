import numpy as np

from trackloom.llm import language_id as li
from trackloom.llm import quality_gbt as qg
from trackloom.llm.common import held_out

from .helpers import AWKWARD, documents

SAID = {"en": "the cat and the dog went to the house with them", "de": "der hund und die katze gingen nicht in das haus", "fr": "le chien et le chat sont dans la maison avec nous"}


def sayings(n=240):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        lang = list(SAID)[i % 3]
        words = SAID[lang].split()
        out.append((i, " ".join(rng.permutation(words)[:7]), lang))
    return out


def test_held_out_fold_is_crc32(spark):
    import zlib

    got = documents(spark, [(i, "") for i in range(50)] + [(None, "")]).select("doc_id", held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = documents(spark, sayings() + [(1000, "no language", None), (1001, None, "en")], extra=True)
    model = li.train(docs)
    assert model.languages == ["de", "en", "fr"]
    got = li.predict(docs.select("doc_id", "text", "lang"), model).where(held_out()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["lang"]]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_awkward_texts(spark):
    model = li.train(documents(spark, sayings()))
    got = {r["doc_id"]: r for r in li.predict(documents(spark, AWKWARD, extra=True), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4
    assert got[5]["lang_pred"] in model.languages and got[8]["score"] == 0
    assert li.predict(documents(spark, []), model).count() == 0
    nothing = li.train(documents(spark, []))
    assert li.predict(documents(spark, AWKWARD), nothing).where("lang_pred != 'und'").count() == 0


def test_frequencies_cover_all_training_documents(spark):
    rows = [(i, "abc" if i % 2 else "xyz", "en") for i in range(400)]
    model = li.train(documents(spark, rows), sample_rows=20)
    import zlib

    used = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    share = li.ngram_counts("abc", model.bits) > 0
    assert np.allclose(model.idf[share], np.log((1 + len(used)) / (1 + used.count("abc"))) + 1)


def test_ftrl_reaches_zero_weights_with_a_strong_l1():
    learner = li.Ftrl(4, 2, 1.0, 1.0, 100.0, 0.0)
    for k in range(50):
        learner.step(np.array([k % 4]), np.array([1.0]), k % 2)
    assert not learner.weights().any()


def test_temperature_softens_overconfident_logits():
    z = np.array([[8.0, 0.0]] * 10)
    labels = np.array([0] * 7 + [1] * 3)
    assert li.fit_temperature(z, labels) > 4
    assert li.fit_temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def slow_margin(model, row):
    total = model.base
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
        at = 0
        while at < len(f):
            at = 2 * at + (2 if row[f[at]] > t[at] else 1)
        total += leaf[at - len(f)]
    return total


def test_flat_traversal_equals_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = qg.fit_trees(x, y, trees=30, depth=3)
    assert np.allclose(model.margin(x), [slow_margin(model, r) for r in x])
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    assert qg.fit_trees(x, np.ones(500)).score(x).min() > 0.9
    assert qg.fit_trees(np.zeros((0,)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_quality_scores(spark):
    rng = np.random.default_rng(4)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, " ".join(rng.permutation(words)) if i % 3 else " ".join(w.upper() + "!!" for w in rng.permutation(words))) for i in range(300)]
    docs = documents(spark, rows + AWKWARD[4:5], extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (3, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = qg.train(docs, labels)
    got = qg.score(docs, model).where(held_out()).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in got]) > 0.95
    assert len(qg.score(documents(spark, AWKWARD), model).collect()) == len(AWKWARD)
    assert qg.score(documents(spark, []), model).count() == 0
    blank = qg.train(docs, labels.limit(0))
    assert {r["score"] for r in qg.score(documents(spark, AWKWARD), blank).collect()} == {0.5}


def slow_boosting(x, y, trees, depth, rate, l2, least, bins):
    """Newton boosting by direct sums over every candidate threshold; returns the margins of the rows."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    margin = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        nodes = [np.arange(len(x))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best, at = 1e-6, None
                worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)  # noqa: E731, B023
                for j, column in enumerate(edges):
                    for t in column:
                        left, right = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                        gain = worth(left) + worth(right) - worth(rows)
                        if h[left].sum() >= least and h[right].sum() >= least and gain > best + 1e-12:
                            best, at = gain, (left, right)
                below += at or (rows, rows[:0])
            nodes = below
        for rows in nodes:
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return margin


def test_histogram_splits_equal_direct_sums():
    rng = np.random.default_rng(5)
    for seed in range(4):
        x = np.random.default_rng(seed).normal(size=(150, 4))
        x[:, 2] = np.round(x[:, 2])
        y = (x[:, 0] + 0.5 * x[:, 2] + rng.normal(size=150) > 0).astype(float)
        model = qg.fit_trees(x, y, trees=6, depth=3, bins=12)
        assert np.allclose(model.margin(x), slow_boosting(x, y, 6, 3, 0.15, 1.0, 2.0, 12))


def test_statistics_of_parts_equal_those_of_the_whole(monkeypatch):
    text = "Some words. Some words, again! | a\tb\n\nSome more lines here\n" * 40
    whole = qg.statistics(text)
    monkeypatch.setattr(qg, "PART_CHARS", 50)
    assert np.allclose(qg.statistics(text), whole)
    named = dict(zip(qg.FEATURES, whole))
    words = text.split()
    assert named["unique_words"] == len(set(words)) / len(words) and named["unique_pairs"] == len(set(zip(words, words[1:]))) / (len(words) - 1)


def slow_counts(text, bits):
    """Hashed 1- to 3-grams one by one, in plain integers."""
    c = [ord(x) for x in text.lower()]
    m = 0xFFFFFFFF
    one = [x * 0x9E3779B1 & m for x in c]
    two = [((a ^ (b >> 15)) * 0x85EBCA77 + b) & m for a, b in zip(one, one[1:])]
    three = [((a ^ (b >> 13)) * 0xC2B2AE3D + x) & m for a, b, x in zip(two, two[1:], one[2:])]
    out = {}
    for h in one + two + three:
        k = (h * 0x27D4EB2F & m) >> (32 - bits)
        out[k] = out.get(k, 0) + 1
    return out


def test_ngrams_and_weights_equal_plain_versions():
    import math

    for text in ("", "a", "ab", "Ünï cödé, twice twice"):
        got = li.ngram_counts(text, 10)
        assert {k: int(v) for k, v in enumerate(got) if v} == slow_counts(text, 10)
    idf = np.linspace(1, 3, 1 << 10)
    model = li.LanguageModel(["x"], np.zeros((1 << 10, 1)), np.zeros(1), idf, 10)
    counts = slow_counts("some text of some words", 10)
    keys = sorted(counts)
    raw = [(1 + math.log(counts[k])) * idf[k] for k in keys]
    length = math.sqrt(sum(v * v for v in raw))
    assert np.allclose(model.vector(np.array(keys), np.array([counts[k] for k in keys])), [v / length for v in raw])


def test_ftrl_equals_one_coordinate_at_a_time():
    import math

    rng = np.random.default_rng(3)
    size, classes, alpha, beta, l1, l2 = 6, 3, 0.5, 1.0, 0.02, 0.1
    learner = li.Ftrl(size, classes, alpha, beta, l1, l2)
    z, n = {}, {}

    def weight(key):
        s = z.get(key, 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)

    for _ in range(60):
        idx = np.sort(rng.choice(size, 3, replace=False))
        x, label = rng.random(3), int(rng.integers(classes))
        learner.step(idx, x, label)
        row = [*zip(idx.tolist(), x.tolist()), (size, 1.0)]
        margins = [sum(v * weight((i, c)) for i, v in row) for c in range(classes)]
        exps = [math.exp(m) for m in margins]
        updates = []
        for c in range(classes):
            error = exps[c] / sum(exps) - (c == label)
            updates += [((i, c), v * error, weight((i, c))) for i, v in row]
        for key, g, w in updates:
            sigma = (math.sqrt(n.get(key, 0.0) + g * g) - math.sqrt(n.get(key, 0.0))) / alpha
            z[key] = z.get(key, 0.0) + g - sigma * w
            n[key] = n.get(key, 0.0) + g * g
    assert np.allclose(learner.weights(), [[weight((i, c)) for c in range(classes)] for i in range(size + 1)])


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat and the dog went out", "en") for i in range(300)] + [(1000 + i, "der hund und die katze", "de") for i in range(4)]
    rows += [rows[0]] * 50
    model = li.train(documents(spark, rows), sample_rows=20)
    assert model.languages == ["de", "en"] and model.predict("die katze und der hund")[0] == "de"
