"""The registered queries: contract columns, whole tables, and DuckDB text where there is one."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from trackloom.llm import queries
from trackloom.llm.pii import BASE_KINDS

from .test_packing import reference
from .test_pii import BASE, holds
from .test_simhash import components, slow_fingerprint

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op3_quality_gbt": "doc_id held_out score predicted",
    "op4_harmonic_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5_lsm_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op6_simhash_bk": "doc_id fingerprint component_id",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op9_pii_spans": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.sql("select doc_id, text from documents").fetchall())


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    rows = lambda df: sorted(df[sorted(df.columns)].itertuples(index=False, name=None), key=str)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    assert queries.queries()[name](spark, SF).columns == COLUMNS[name].split()


def test_pieces_are_the_tokenizers_ids(spark, docs):
    got = queries.op4_harmonic_packing(spark, SF).toPandas().sort_values(["doc_id", "start"])
    for doc, rows in got.groupby("doc_id"):
        ids = np.array(reference(docs[doc]), "<u4")
        assert rows["length"].sum() == len(ids) == rows["doc_tokens"].iloc[0]
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert set(got["doc_id"]) == set(docs)
    sizes = got.groupby("sequence_id")["length"].sum()
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes) < 0.01 * sizes.sum()


def test_packed_sequences_hold_every_token(spark, docs):
    got = queries.op1_bfd_token_packing(spark, SF).select("n_tokens", "doc_ids").toPandas()
    assert got["n_tokens"].sum() == sum(len(reference(t)) for t in docs.values())
    assert {d for ids in got["doc_ids"] for d in ids} == set(docs)


def test_components(spark, docs):
    got = queries.op6_simhash_bk(spark, SF).toPandas()
    fps = {d: slow_fingerprint(t) for d, t in docs.items()}
    assert dict(zip(got["doc_id"], got["fingerprint"])) == {d: f"{f:016x}" for d, f in fps.items()}
    distinct = sorted(set(fps.values()))
    part = components([(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 3], distinct)
    least = {}
    for d, f in fps.items():
        least[part[f]] = min(d, least.get(part[f], d))
    assert dict(zip(got["doc_id"], got["component_id"])) == {d: least[part[f]] for d, f in fps.items()}


def test_spans(spark, docs):
    got = {r["doc_id"]: r for r in queries.op9_pii_spans(spark, SF).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        spans = [f"{k}:{m.start()}:{m.end()}" for k in BASE_KINDS for m in re.finditer(BASE[k], text or "") if holds(k, m[0])]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert sum(got[d][f"n_{k}"] for k in BASE_KINDS) == len(spans)
        assert set(spans) <= set(got[d]["spans"].split(","))


def test_held_out_accuracy(spark, duck):
    lang = queries.op7_language_id(spark, SF).toPandas().merge(duck.sql("select doc_id, lang from documents").df())
    assert (lang["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in lang["doc_id"]]).all()
    held = lang[lang["held_out"] & lang["lang"].notna()]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    good = queries.op3_quality_gbt(spark, SF).toPandas()
    assert (good["predicted"] == (good["score"] >= 0.7)).all() and good["score"].between(0, 1).all()
    held = good[good["held_out"]].merge(duck.sql("select doc_id, quality from labels").df())
    assert (held["predicted"] == held["quality"]).mean() > 0.8


def test_leaks(spark, duck, docs):
    got = queries.op8_pigeonhole_decontamination(spark, SF).toPandas()
    items = dict(duck.sql("select item_id, text from benchmark").fetchall())
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if t and x in t}
    assert exact <= set(zip(got["doc_id"], got["item_id"]))
