"""Best-fit-decreasing packing to binary token-id matrices.

Each worker tokenises its partition and packs blocks of bounded token count: pieces
in decreasing length, each placed in the fullest open sequence that still has room. A
segment tree over the residual capacities 0..C answers "smallest capacity >= length
with an open sequence" in O(log C). Overlong documents are cut losslessly at the
capacity; only their last piece competes for room. Nothing is shuffled, the block bound
caps memory, and a lost task repeats with the same result.

A very long text is tokenised in parts, but its ids are held as a whole (four bytes each) while it is cut.

Output: one row per sequence, i.e. one row of the id matrix. ``ids`` holds C
little-endian uint32 ids (padding at the end), ``cu_seqlens`` the cumulative segment
lengths from 0, ``position_ids`` restart at 0 with every segment, ``doc_ids`` and
``doc_starts`` say where each segment came from, so documents can be rebuilt.

Defined results: null and empty texts hold just the end id; repeated rows are packed as
rows of their own; ids keep their type and a null one stays null; other columns are not read,
whatever their names; an empty table gives no sequences.
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

BEFORE_IDS = "sequence_id long, n_tokens int, n_segments int"
AFTER_IDS = "doc_starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


def sequence_type(id_type: T.DataType) -> T.StructType:
    ids = T.StructField("doc_ids", T.ArrayType(id_type))
    return T.StructType([*T.StructType.fromDDL(BEFORE_IDS), ids, *T.StructType.fromDDL(AFTER_IDS)])


class CapacityTree:
    """Complete binary tree over residual capacities; a node counts open bins below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, residual: int, which: int) -> None:
        self.bins[residual].append(which)
        self._add(residual, 1)

    def _add(self, residual: int, d: int) -> None:
        i = residual + self.size
        while i:
            self.count[i] += d
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (bin, residual) with the smallest residual >= need, if any."""
        i, count = need + self.size, self.count
        if not count[i]:
            # climb until a right sibling holds a bin, then go down its left edge
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i <<= 1
                if not count[i]:
                    i += 1
        residual = i - self.size
        which = self.bins[residual].pop()
        self._add(residual, -1)
        return which, residual


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Ties in length keep input order."""
    tree = CapacityTree(capacity)
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[item])
        if found is None:
            which, residual = len(bins), capacity
            bins.append([])
        else:
            which, residual = found
        bins[which].append(item)
        if residual > lengths[item]:
            tree.put(residual - lengths[item], which)
    return bins


def pack_token_ids(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    block_tokens: int = 1 << 21,
    pad_id: int = 0,
    end_id: int = 1,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    path = tokenizer or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    schema = sequence_type(rows.schema["d"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        following = TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []
        held = 0
        for doc, ids in encode_batches(batches, path, end_id):
            for s in range(0, len(ids), capacity):
                # a copy, so that a piece does not keep its whole slice
                pieces.append((doc, s, ids[s : s + capacity].copy()))
                held += len(pieces[-1][2])
                if held >= block_tokens:
                    yield from _matrix(pieces, capacity, pad_id, following, out)
                    following += len(pieces)
                    pieces, held = [], 0
        if pieces:
            yield from _matrix(pieces, capacity, pad_id, following, out)

    return map_batches(rows, pack, schema)


def _matrix(pieces: list[tuple], capacity: int, pad_id: int, first: int, schema: pa.Schema, rows: int = 256) -> Iterator[pa.RecordBatch]:
    packed = best_fit_decreasing([len(p[2]) for p in pieces], capacity)
    for at in range(0, len(packed), rows):
        some = packed[at : at + rows]
        ids, pos = np.full((len(some), capacity), pad_id, "<u4"), np.zeros((len(some), capacity), "<u4")
        docs, starts, bounds = [], [], []
        for k, items in enumerate(some):
            cu = [0]
            for i in items:
                seg = pieces[i][2]
                ids[k, cu[-1] : cu[-1] + len(seg)] = seg
                pos[k, cu[-1] : cu[-1] + len(seg)] = np.arange(len(seg))
                cu.append(cu[-1] + len(seg))
            docs.append([pieces[i][0] for i in items])
            starts.append([pieces[i][1] for i in items])
            bounds.append(cu)
        columns = [range(first + at, first + at + len(some)), [c[-1] for c in bounds], [len(d) for d in docs], docs, starts, bounds, [x.tobytes() for x in ids], [x.tobytes() for x in pos]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
