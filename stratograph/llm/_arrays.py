"""Whole Arrow batches of texts as numpy arrays: word boundaries and 64-bit word hashes without a loop over words.

UTF-8 lets both word classes of the operators be read off single bytes, as every byte from 0x80 on belongs to a
non-ASCII character: ``SPACE_WORDS`` are runs of anything but ASCII white space, ``ALNUM_WORDS`` runs of a-z, 0-9 and
non-ASCII characters.  A-Z are lowered in place.

A word's hash is a polynomial over its bytes modulo 2**64, taken as a difference of running sums, mixed with its length.
Two words are taken as equal if their hashes are; among 10**9 different words the chance of any clash is about 3 %, and
operators that report single matches compare the bytes again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SPACE_WORDS = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
ALNUM_WORDS = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 2**64)
#: Bytes of text handled at once; a longer word extends its block.
BLOCK = 1 << 18
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["up"]) < n:
        for name, base in (("up", _R), ("down", _RINV)):
            factors = np.full(max(n, 2 * BLOCK), base, dtype=U)
            factors[0] = 1
            _tables[name] = np.multiply.accumulate(factors)
    return _tables["up"], _tables["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


def chunks_of(column: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most_bytes`` of text each; a longer text is a range of its own."""
    _, offsets = texts_of(column)
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


class Words:
    """The words of some texts, in order: ``starts`` and ``ends`` in ``raw`` (lowered), ``first`` (n + 1 places: the
    words of text i are first[i] to first[i + 1]), ``hashes``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACE_WORDS, lower: bool = True):
        self.raw = LOWER[raw] if lower else raw
        inside = kind[self.raw]
        edge = np.empty(len(inside) + 1, dtype=bool)
        if len(inside):
            edge[0], edge[-1] = inside[0], inside[-1]
            edge[1:-1] = inside[1:] != inside[:-1]
        else:
            edge[0] = False
        # a text's end ends its last word, and the next text's first word starts there
        places = np.flatnonzero(edge)
        starts, ends = places[0::2], places[1::2]
        joints = np.unique(offsets[1:-1])
        joints = joints[(joints > 0) & (joints < len(inside))] if len(inside) else joints[:0]
        joints = joints[inside[joints] & inside[joints - 1]] if len(joints) else joints
        if len(joints):
            starts, ends = np.sort(np.concatenate([starts, joints])), np.sort(np.concatenate([ends, joints]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, offsets, side="left")
        self.hashes = self._hash()

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=U)
        at = 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + BLOCK, side="right")))
            stop = self.ends[to - 1]
            up, down = _powers(int(stop - base) + 1)
            sums = np.zeros(int(stop - base) + 1, dtype=U)
            np.cumsum((self.raw[base:stop].astype(U) + U(1)) * up[: stop - base], out=sums[1:])
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            h = (sums[e] - sums[s]) * down[s]
            out[at:to] = mixed(h + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
            at = to
        return out

    def text(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    h = hashes[:n].copy()
    for k in range(1, size):
        h *= U(_R)
        h += hashes[k : n + k]
        h ^= h >> U(29)
    return mixed(h)


def give_back() -> None:
    """Free memory goes back to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def grouped(batches, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.Table]:
    """The rows of Arrow batches in groups with at most ``most_bytes`` in ``column``; a longer text is alone."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        for a, b in chunks_of(texts, most_bytes):
            part = batch.slice(a, b - a)
            n = int(texts_of(texts.slice(a, b - a))[1][-1])
            if held and size + n > most_bytes:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = None
    give_back()


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list array with ``counts[i]`` of the values in row i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
