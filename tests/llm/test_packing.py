import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackloom.llm import harmonic_packing as hp
from trackloom.llm import token_packing as tp
from trackloom.llm import tokenise
from trackloom.llm.tokenise import WordTokeniser, vocabulary_path

from .helpers import AWKWARD, documents

LIBRARY = Tokenizer.from_file(vocabulary_path())
MINE = WordTokeniser(vocabulary_path())


def reference(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZé'Σ .,!9\t\n\x1c\x85 |<>\x00")), max_size=60))
def test_tokeniser_equals_the_library(text):
    assert MINE.encode(text).tolist() == reference(text)[:-1]


def test_special_strings_and_long_runs():
    for text in ("<|endoftext|> hi", "a" * 3000, "don't can't we'll", "été"):
        assert MINE.encode(text).tolist() == reference(text)[:-1]


def check_pieces(rows, docs, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc, text in {d: t for d, t in docs}.items():
        want = reference(text)
        parts = sorted(by_doc[doc])
        copies = sum(1 for d, _ in docs if d == doc)
        assert sorted(x for p in parts for x in p[1]) == sorted(want * copies)
        assert {p[2] for p in parts} == {len(want)}
        if copies == 1:
            assert [x for p in parts for x in p[1]] == want
    return [sum(n for _, n in s) for s in by_seq.values()]


def test_harmonic_pack_places_every_id_once(spark):
    sizes = check_pieces(hp.harmonic_pack(documents(spark, AWKWARD, extra=True)).collect(), AWKWARD, 2048)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding <= 0.02 * sum(sizes)


def test_harmonic_pack_of_an_empty_table(spark):
    assert hp.harmonic_pack(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=60), st.sampled_from([64, 100, 256]))
def test_harmonic_classes_hold_fixed_counts(lengths, capacity):
    packer = hp.HarmonicPacker(capacity)
    placed = [p for i, n in enumerate(lengths) for p in packer.add(i, np.arange(n))]
    full = {p[4] for p in placed}
    for b in full:
        pieces = [p for p in placed if p[4] == b]
        size = sum(len(p[2]) for p in pieces)
        assert (1 - packer.slack) * capacity <= size <= capacity or size >= capacity - len(pieces)
        assert [p[5] for p in pieces] == np.cumsum([0, *(len(p[2]) for p in pieces)]).tolist()[:-1]
    placed += list(packer.finish())
    for i, n in enumerate(lengths):
        assert sorted(x for p in placed if p[0] == i for x in p[2].tolist()) == list(range(n))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_segment_tree_picks_the_best_fit(lengths):
    bins, room, slow = tp.best_fit_decreasing(lengths, 50), [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room[room.index(min(fits))] -= lengths[i]
        else:
            room.append(50 - lengths[i])
    slow = sorted(50 - r for r in room)
    assert sorted(sum(lengths[i] for i in b) for b in bins) == slow
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))


@pytest.mark.parametrize("block", [1 << 21, 3000])
def test_matrices_rebuild_every_document(spark, block):
    rows = tp.pack_token_ids(documents(spark, AWKWARD, extra=True), capacity=512, block_tokens=block).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    parts = {}
    for r in rows:
        ids, pos = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        assert len(ids) == len(pos) == 512 and r["cu_seqlens"][-1] == r["n_tokens"] and len(r["doc_ids"]) == r["n_segments"]
        assert not ids[r["n_tokens"] :].any()
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["doc_starts"])):
            a, b = r["cu_seqlens"][k : k + 2]
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for doc, text in AWKWARD:
        if doc != 6:
            assert [x for _, p in sorted(parts[doc]) for x in p] == reference(text)
    assert len(parts[6]) == 2
    assert tp.pack_token_ids(documents(spark, [])).count() == 0


def test_slices_and_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(tokenise, "SLICE_BYTES", 64)
    texts = ["", None, "Don't stop, ÀÉÎ × ÷ naïve! 12,5 " * 20, "x" * 300, "a b " * 100, " ", "Ünïcode Ωmega é <|endoftext|>", "and,and;AND"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["d", "t"])
    got = list(tokenise.encode_batches(iter([batch, batch.slice(2, 3)]), vocabulary_path(), 1))
    assert [(k, ids.tolist()) for k, ids in got] == [(k, reference(texts[k])) for k in [*range(len(texts)), 2, 3, 4]]


def test_ids_keep_their_type(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, "three")], "doc_id string, text string")
    assert {r["doc_id"] for r in hp.harmonic_pack(docs).collect()} == {"a", None}
    assert {d for r in tp.pack_token_ids(docs).collect() for d in r["doc_ids"]} == {"a", None}
