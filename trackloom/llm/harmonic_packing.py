"""Harmonic packing: lengths fall into reciprocal-capacity classes.

A piece of length r belongs to class k when C/(k+1) < r <= C/k, and a bin of class k closes once it
holds exactly k pieces. Pieces of at most C/``classes`` tokens form the last class, whose bins are filled one after
another. No bin is shared between workers, so every input partition packs alone: no shuffle, and memory is one
open bin per class.

Documents may be cut. While a tail of class k would leave more than ``slack`` of a class-k bin empty
(k*r < (1-slack)*C), a piece of exactly floor(C/(k+1)) tokens is cut off it, which fills its own class
without waste; the rest shrinks quadratically, so a tail is cut about once. A piece of the last class is cut where its
bin is full. When a worker's input ends, each class has at most one open bin: their pieces join the last class, and what is
left of that goes into sequences of power-of-two lengths, which need no padding.

Few classes keep both small: the pieces that a partition's end moves to the last class (below ``classes`` squared)
and the cuts of a document.

Defined results: null and empty texts hold just the end id; repeated rows are packed as rows of their own; very long
texts are tokenised in parts and streamed to the bins; ids keep their type and a null one is carried through; other
columns are not read, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches
from .tokenise import encode_batches, vocabulary_path

PLACED = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class HarmonicPacker:
    """Streams (doc, ids) in, yields placed pieces (doc, start, ids, doc_tokens, bin, offset)."""

    def __init__(self, capacity: int = 2048, slack: float = 1 / 128, classes: int = 8, first_bin: int = 0):
        if classes < 2:
            raise ValueError("at least two classes")
        self.capacity, self.slack, self.classes, self.next_bin = capacity, slack, classes, first_bin
        self.waiting: dict[int, list] = {}
        self.small: list[tuple] = []
        self.room = capacity

    def lengths(self, n: int) -> Iterator[tuple[int, int]]:
        """(length, class) of the pieces a document of n tokens is cut into, in order."""
        c = self.capacity
        while n > 0:
            if n >= c:
                yield c, 1
                n -= c
                continue
            k = c // n
            if k >= self.classes or k * n >= (1 - self.slack) * c:
                yield n, min(k, self.classes)
                return
            cut = c // (k + 1)
            yield cut, k + 1
            n -= cut

    def _close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.next_bin, at
            at += len(ids)
        self.next_bin += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for length, k in self.lengths(len(ids)):
            piece = (doc, start, ids[start : start + length], len(ids))
            start += length
            if k == self.classes:
                yield from self._add_small(piece)
                continue
            pending = self.waiting.setdefault(k, [])
            pending.append(piece if k == 1 else _own(piece))
            if len(pending) == k:
                del self.waiting[k]
                yield from self._close(pending)

    def _add_small(self, piece: tuple) -> Iterator[tuple]:
        doc, start, ids, total = piece
        while len(ids) >= self.room:
            full, self.small = [*self.small, (doc, start, ids[: self.room], total)], []
            start, ids, self.room = start + self.room, ids[self.room :], self.capacity
            yield from self._close(full)
        if len(ids):
            self.small.append(_own((doc, start, ids, total)))
            self.room -= len(ids)

    def finish(self) -> Iterator[tuple]:
        for k in sorted(self.waiting):
            for piece in self.waiting[k]:
                yield from self._add_small(piece)
        self.waiting = {}
        rest, self.small = self.small, []
        left, self.room = self.capacity - self.room, self.capacity
        while left:
            # the largest power of two that what is left can fill
            room = 1 << (left.bit_length() - 1)
            left -= room
            taken, over = [], []
            for doc, start, ids, total in rest:
                take = min(len(ids), room)
                room -= take
                if take:
                    taken.append((doc, start, ids[:take], total))
                if take < len(ids):
                    over.append((doc, start + take, ids[take:], total))
            rest = over
            yield from self._close(taken)


def _own(piece: tuple) -> tuple:
    """A waiting piece holds its own ids, not a view of its whole slice."""
    doc, start, ids, total = piece
    return doc, start, ids.copy(), total


def harmonic_pack(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    slack: float = 1 / 128,
    classes: int = 8,
    end_id: int = 1,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise ``docs`` and pack them; one row per piece with its ids (little-endian uint32).

    ``sequence_id`` is the partition number (upper bits) and the worker's bin count: unique,
    and the same when a lost task runs again.
    """
    path = tokenizer or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["d"].dataType), *T.StructType.fromDDL(PLACED)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        packer = HarmonicPacker(capacity, slack, classes, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []
        held = 0
        for doc, ids in encode_batches(batches, path, end_id):
            for piece in packer.add(doc, ids):
                out.append(piece)
                held += len(piece[2])
                if held > 1 << 20:
                    yield _batch(out, out_schema)
                    out, held = [], 0
        out.extend(packer.finish())
        if out:
            yield _batch(out, out_schema)

    return map_batches(rows, pack, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    doc, start, ids, total, seq, at = zip(*rows, strict=True)
    columns = [doc, start, [len(x) for x in ids], [x.tobytes() for x in ids], total, seq, at]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
