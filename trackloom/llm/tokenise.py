"""Whole-text tokenisation with a public ``tokenizers`` file, a slice of texts at a time.

The vocabulary's normaliser lower-cases and composes characters one neighbourhood at a time and its
pre-tokeniser drops white space, so a text's ids are those of its white-space-separated chunks laid end
to end. A slice's chunks are dictionary-encoded and each different chunk is tokenised once:

* chunks of ASCII and of Latin letters up to U+00FF are cut to pieces (runs of letters, single digits, runs of
  signs), and the byte-pair merges of all different pieces run together, one merge of every piece a round;
* chunks with other characters, apostrophes, special strings or very long pieces go through the library itself.

Nothing is kept between slices. Memory is a multiple of ``SLICE_BYTES``: longer texts are cut at white space, and only a
single chunk longer than that takes more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import cut_text, release_memory

WORD_VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are tokenised together, and the longest piece that is merged here.
SLICE_BYTES = 1 << 21
PIECE_BYTES = 48

_LETTER, _DIGIT, _SIGN, _HARD = range(4)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = _LETTER
_CLASS[0x80:] = _HARD
_CLASS[ord("'")] = _HARD
# 0xC3 leads the two-byte forms of U+00C0 to U+00FF, all letters but the two signs set apart below
_CLASS[0x80:0xC0] = _CLASS[0xC3] = _LETTER
_TIMES, _DIVIDE = 0x97, 0xB7


def vocabulary_path(name: str = WORD_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def _gather(values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``codes`` of a ragged array, end to end, and their bounds; ``starts`` has one more entry than there are."""
    first, n = starts[:-1][codes], np.diff(starts)[codes]
    bounds = _sums(n)
    return values[np.repeat(first - bounds[:-1], n) + np.arange(bounds[-1])], bounds


class PairTable:
    """(left, right) -> rank of their merge, looked up for whole arrays; each table takes what the one before had no room for."""

    NONE = np.int32(np.iinfo(np.int32).max)
    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys, ranks = self._key(left, right), np.arange(len(left), dtype=np.int32)
        self.tables, bits = [], 18
        while len(keys):
            at = self._slot(keys, bits)
            held = np.full(1 << bits, -1, np.int64)
            rank = np.full(1 << bits, self.NONE, np.int32)
            held[at], rank[at] = keys, ranks
            out = held[at] != keys
            self.tables.append((bits, held, rank))
            keys, ranks, bits = keys[out], ranks[out], bits - 1

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * self._FACTOR) >> np.uint64(64 - bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        out = np.full(keys.shape, self.NONE, np.int32)
        for bits, held, rank in self.tables:
            at = self._slot(keys, bits)
            np.copyto(out, rank[at], where=held[at] == keys)
        return out


class WordTokeniser:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self._pairs = PairTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]))
        self._merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._inner, self._last = np.full(256, -1, np.int32), np.full(256, -1, np.int32)
        for byte, char in _byte_alphabet().items():
            self._inner[byte], self._last[byte] = vocab[char], vocab[char + suffix]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_texts(pa.array([text], pa.string()))[0]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts end to end, and each text's bounds in them; null and empty texts have none."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        lists = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        ids, bounds = _gather(*self._chunks(coded.dictionary), coded.indices.to_numpy())
        return ids.astype("<u4"), bounds[lists - lists[0]]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk end to end and their bounds."""
        if not len(chunks):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        at = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
        raw = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = (at - at[0]).astype(np.int64)
        kind, low = _CLASS[raw], np.where((raw >= 65) & (raw <= 90), raw | 0x20, raw)
        latin = np.concatenate(([False], raw[:-1] == 0xC3)) if len(raw) else np.zeros(0, bool)
        kind[latin & ((raw == _TIMES) | (raw == _DIVIDE))] = _HARD
        low = np.where(latin & (raw <= 0x9E) & (raw >= 0x80), low | 0x20, low)
        kind[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = _HARD

        first = np.ones(len(raw), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        first[at[:-1][at[:-1] < len(raw)]] = True
        cuts = np.append(np.flatnonzero(first), len(raw))
        of_chunk = np.searchsorted(cuts, at)
        long = _sums(np.diff(cuts) > PIECE_BYTES)
        hard = (np.diff(_sums(kind == _HARD)[at]) > 0) | (np.diff(long[of_chunk]) > 0)

        # of a hard chunk only the first piece stays, to stand for the whole chunk
        n_pieces = np.diff(of_chunk)
        in_hard = np.repeat(hard, n_pieces)
        binary = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(low)])
        easy = binary.filter(pa.array(~in_hard)).dictionary_encode()
        ids, starts = self._merge(easy.dictionary)
        whole = self._library(chunks.filter(pa.array(hard)).to_pylist())
        starts = np.concatenate((starts, starts[-1] + np.cumsum([len(x) for x in whole], dtype=np.int64)))
        ids = np.concatenate([ids, *whole])
        codes = np.zeros(len(cuts) - 1, np.int64)
        codes[~in_hard] = easy.indices.to_numpy()
        codes[of_chunk[:-1][hard]] = len(easy.dictionary) + np.arange(len(whole))
        stays = ~in_hard
        stays[of_chunk[:-1][hard]] = True
        ids, bounds = _gather(ids, starts, codes[stays])
        return ids, bounds[_sums(stays)[of_chunk]]

    def _library(self, chunks: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self._whole.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []

    def _merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair merges of different pieces of at most ``PIECE_BYTES`` bytes."""
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        raw = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        n = np.diff(at)
        counts = np.zeros(len(pieces), np.int64)
        done = []
        low = 0
        for width in (3, 6, 8, 10, 12, 15, 20, 30, PIECE_BYTES):
            which = np.flatnonzero((n > low) & (n <= width))
            low = width
            if len(which):
                places = at[which][:, None] + np.arange(width)
                inside = np.arange(width) < n[which][:, None]
                symbols = np.where(inside, self._inner[raw[np.minimum(places, len(raw) - 1)]], -1)
                symbols[np.arange(len(which)), n[which] - 1] = self._last[raw[at[which + 1] - 1]]
                symbols = self._rounds(symbols)
                counts[which] = (symbols >= 0).sum(axis=1)
                done.append((which, symbols[symbols >= 0]))
        starts = _sums(counts)
        ids = np.zeros(starts[-1], np.int32)
        for which, got in done:
            bounds = _sums(counts[which])
            ids[np.repeat(starts[which] - bounds[:-1], counts[which]) + np.arange(len(got))] = got
        return ids, starts

    def _rounds(self, symbols: np.ndarray) -> np.ndarray:
        """Each round merges every row's leftmost pair of least rank; -1 fills the rows' ends."""
        out = symbols
        rows, width = np.arange(len(symbols)), symbols.shape[1]
        none = np.full((len(symbols), 1), PairTable.NONE)
        rank = np.concatenate((self._pairs.ranks(symbols[:, :-1], symbols[:, 1:]), none), axis=1)
        places = np.arange(width)
        while True:
            best = rank.argmin(axis=1)
            least = rank[np.arange(len(rank)), best]
            go = least < PairTable.NONE
            if not go.all():
                out[rows[~go]] = symbols[~go]
                rows, symbols, rank, best, least = rows[go], symbols[go], rank[go], best[go], least[go]
            if not len(rows):
                return out
            line = np.arange(len(rows))
            # what lies behind the merged pair moves one place to the left
            source = np.minimum(places + (places > best[:, None]), width - 1)
            symbols, rank = np.take_along_axis(symbols, source, 1), np.take_along_axis(rank, source, 1)
            symbols[:, -1], rank[:, -1] = -1, PairTable.NONE
            symbols[line, best] = self._merged[least]
            before, after = np.maximum(best - 1, 0), np.minimum(best + 1, width - 1)
            joined = symbols[line, best]
            rank[line, best] = self._pairs.ranks(joined, symbols[line, after])
            left = self._pairs.ranks(symbols[line, before], joined)
            rank[line[best > 0], before[best > 0]] = left[best > 0]


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for those from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(other)}


_CACHE: dict[str, WordTokeniser] = {}


def word_tokeniser(path: str) -> WordTokeniser:
    """One tokeniser per worker process and file."""
    if path not in _CACHE:
        _CACHE[path] = WordTokeniser(path)
        release_memory()
    return _CACHE[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[object, np.ndarray]]:
    """(id, token ids with the end id) of each row of batches (id, text), in order."""
    tok = word_tokeniser(path)
    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1)
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, row = np.cumsum(sizes), 0
        while row < len(names):
            stop = max(row + 1, int(np.searchsorted(upto, upto[row] - sizes[row] + SLICE_BYTES, side="right")))
            if stop == row + 1 and sizes[row] > SLICE_BYTES:
                yield names[row], np.concatenate([*(tok.encode(t) for t in cut_text(texts[row].as_py(), SLICE_BYTES)), [end_id]]).astype("<u4")
            else:
                ids, bounds = tok.encode_texts(texts.slice(row, stop - row))
                bounds = bounds + np.arange(len(bounds))
                ended = np.full(bounds[-1], end_id, "<u4")
                is_id = np.ones(bounds[-1], bool)
                is_id[bounds[1:] - 1] = False
                ended[is_id] = ids
                for k, name in enumerate(names[row:stop]):
                    yield name, ended[bounds[k] : bounds[k + 1]]
            row = stop
