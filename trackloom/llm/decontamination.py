"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are normalised alike (lower case, runs of other than letters and digits become
one space). An item of n characters has an error budget of e = floor(n * ``error_rate``) edits, whatever its length, and is
cut into e + 1 pieces (of six characters or more at the rate of 0.08): wherever it occurs with at most e edits, one
piece occurs unchanged. All pieces of a block of items form one
Aho-Corasick automaton; a piece hit gives the window where the item would lie, and Myers' bit-parallel
algorithm finds the least edit distance of the item to any substring of that window.

Items are the stated query set: they are read in blocks of bounded text (``block_chars``), each broadcast
in turn, and documents are scanned where they lie, without a shuffle.

Defined results: null and empty documents match nothing; items without a letter or digit are no test;
repeated items count once, and of several texts under one item id the nearest; item ids keep their type; repeated
documents are scanned as rows of their own; very long texts are scanned whole, in memory that is a multiple of their length;
a column that clashes with an inner name is carried through untouched; an empty table on either side gives no match.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def budget(n: int, error_rate: float) -> int:
    """Edits allowed for an item of n characters."""
    return int(n * error_rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal length."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least distance of the pattern to a substring of ``text``, where the first such substring ends)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, at
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, end


class ItemMatcher:
    """Automaton over the pieces of a block of items (id, text)."""

    def __init__(self, items: list[tuple], error_rate: float):
        import ahocorasick

        self.items = []
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in sorted({(i, normalise(t)) for i, t in items if normalise(t)}, key=lambda x: (x[0] is None, x)):
            e = budget(len(text), error_rate)
            for offset, piece in pieces(text, e):
                by_piece.setdefault(piece, []).append((len(self.items), offset + len(piece)))
            self.items.append((item_id, text, e, pattern_masks(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, where)
        if by_piece:
            self.automaton.make_automaton()

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple]:
        """(item id, distance) of every item that lies in the text within its budget."""
        if not self.items or not text:
            return []
        s = normalise(text)
        starts: dict[int, list[int]] = {}
        for end, where in self.automaton.iter(s):
            for item, piece_end in where:
                starts.setdefault(item, []).append(end + 1 - piece_end)
        out = []
        for item, at in starts.items():
            item_id, pattern, e, masks = self.items[item]
            best = 0 if pattern in s else self._distance(s, pattern, e, masks, at)
            if best <= e:
                out.append((item_id, best))
                if first_only:
                    break
        return out

    @staticmethod
    def _distance(s: str, pattern: str, e: int, masks: dict[str, int], at: list[int]) -> int:
        """Least distance over the windows around the piece hits; overlapping windows are read once."""
        best, m = e + 1, len(pattern)
        spans: list[list[int]] = []
        for a in sorted(set(at)):
            low, high = max(0, a - e), a + m + e
            if spans and low <= spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        for low, high in spans:
            best = min(best, myers(masks, m, s[low:high])[0])
        return best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int):
    """Broadcast blocks of items, each of about ``block_chars`` characters or one item."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    count = max(1, -(-chars // block_chars))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r["item_id"], r["text"]) for r in part.toLocalIterator()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    error_rate: float = 0.08,
    block_chars: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, distance) of every document and item within the item's error budget."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits_type = f"hits array<struct<item_id:{benchmark.schema[item_id].dataType.simpleString()},distance:int>>, any boolean"
    found = []
    for items in _blocks(benchmark, item_id, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make(shared=shared):
            m = ItemMatcher(shared.value, error_rate)

            def run(texts: list) -> dict:
                got = [m.matches(t) for t in texts]
                return {"hits": [[{"item_id": i, "distance": d} for i, d in g] for g in got], "any": [bool(g) for g in got]}

            return run

        hit = map_text(rows, make, hits_type, where="any")
        found.append(hit.select("doc_id", F.inline("hits")))
    # an item id may stand for several texts
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, error_rate: float = 0.08, block_chars: int = 4_000_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item; a streaming filter, no shuffle."""
    for items in _blocks(benchmark, item_id, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make(shared=shared):
            m = ItemMatcher(shared.value, error_rate)
            return lambda texts: {"__clean": [not m.matches(t, first_only=True) for t in texts]}

        docs = map_text(docs, make, "__clean boolean", text_col=text_col, where="__clean")
    return docs
