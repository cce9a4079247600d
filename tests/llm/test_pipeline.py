import corpus_pipeline as cp
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialise(stage(spark, docs, SF), name)
        assert docs.columns == names
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert docs.select("doc_id").distinct().count() == counts[-1]
    pieces = cp.packing_stage(spark, docs, SF)
    held = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert held.where("n != t").count() == 0 and held.count() == counts[-1]


def test_awkward_documents_pass_every_stage(spark, tmp_path):
    from .helpers import AWKWARD, documents

    spark.createDataFrame([(1, "a test item that nobody holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (AWKWARD, []):
        docs = documents(spark, rows)
        for name, stage in cp.STAGES:
            docs = cp.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.where("length < 1").count() == 0


def test_stages_equal_brute_force(spark, tmp_path):
    """A small corpus through all stages, against plain Python of each stage on what the one before kept."""
    import random

    import numpy as np

    from trackloom.llm import decontamination as dc
    from trackloom.llm import language_id as li

    from .helpers import documents
    from .test_jaccard import groups
    from .test_lines_and_leaks import slow_repeats
    from .test_models import SAID
    from .test_packing import reference

    rng = random.Random(12)
    words = {k: v.split() + [f"{k}{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)] for k, v in SAID.items()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    item = say("en", 20)
    rows = []
    for d in range(60):
        lang = "en de fr".split()[d % 3]
        lines = [say(lang, 45) for _ in range(3)]
        if d % 4 == 0:
            lines.insert(1, f"All rights of this page are held by owner {d} alone")
        if d % 10 == 3:
            lines.append(item.upper() if d % 20 == 3 else item.replace("a", "e", 1))
        rows.append((d, "\n".join(lines), lang))
    for k in range(10):
        # other first words lead to other leaves of the line tree, so these are left to the near-duplicate stage
        changed = [f"x{chr(97 + k)}{chr(97 + i)} " + x.split(" ", 1)[1] for i, x in enumerate(rows[3 * k + 1][1].split("\n"))]
        rows.append((100 + k, "\n".join(changed), rows[3 * k + 1][2]))
    rows += [(200, "12 34", "en"), (201, None, "en"), (202, "", None), (203, rows[5][1], rows[5][2])]
    docs = documents(spark, rows)
    spark.createDataFrame([(1, item), (2, "no document holds this one at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = li.train(docs)
    want = {d: t for d, t, _ in rows if (p := model.predict(t))[0] != "und" and p[1] >= cp.MIN_LANGUAGE_SCORE}
    assert 60 < len(want) < len(rows)
    drops = slow_repeats(list(want.items()))
    cut = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drops.get(d, [])) for d, t in want.items()}
    cut = {d: t for d, t in cut.items() if d not in drops or t.strip()}
    assert sum(map(len, drops.values())) >= 14
    part = groups(list(cut.items()))
    single = {d: cut[d] for d in cut if d == min(x for x in part if part[x] == part[d])}
    assert len(single) < len(cut)
    norm = dc.normalise(item)
    leaks = lambda t: dc.myers(dc.pattern_masks(norm), len(norm), dc.normalise(t))[0] <= int(0.08 * len(norm))
    clean = {d: t for d, t in single.items() if not leaks(t)}
    assert len(clean) < len(single)

    got = docs
    for (name, stage), kept in zip(cp.STAGES[:-1], (want, cut, single, clean)):
        got = cp.materialise(stage(spark, got, str(tmp_path)), name)
        assert {r["doc_id"]: r["text"] for r in got.collect()} == kept, name
    pieces = {}
    for r in cp.packing_stage(spark, got, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {d: [x for _, p in sorted(v) for x in p] for d, v in pieces.items()} == {d: reference(t) for d, t in clean.items()}
