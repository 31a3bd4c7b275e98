"""Exact ids of a public ``tokenizers`` file for many texts at once, with each distinct piece encoded once.

A byte-level BPE with the usual splitting pattern never lets a token cross from a non-space character into the space
after it.  A text is therefore cut at every single space between two other non-space characters, and the library
encodes the distinct pieces of a block (joined by those spaces, so that it sees ordinary text) once.  A text in which
white space stands next to a space, or a tokenizer of another make, goes to the library whole.

Pieces are found and hashed as numpy arrays (64 bits; a worker keeps about a million, so two of them clash with a chance
under 1e-7), and only distinct ones become Python strings.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from . import _arrays as A

#: Distinct pieces that a worker keeps from one block to the next, about 40 bytes each.
MAX_KEPT = 800_000
JOINED = 2_000
BLOCK_BYTES = 4 << 20
PIECE = np.arange(256) != 32


def unsafe(piece: str) -> bool:
    """Whether white space stands beside a space that cuts this piece off."""
    return piece[0].isspace() or piece[-1].isspace()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        made = json.loads(self.library.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.by_piece = (
            made["model"].get("type") == "BPE"
            and not made["model"].get("dropout")
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and bool(pre.get("use_regex"))
            and made.get("normalizer") is None
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] or t["single_word"] for t in made["added_tokens"])
        )
        # ids whose bytes start with a space
        self.opens = np.zeros(self.vocabulary, dtype=bool)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token.startswith("Ġ")
        self._clear()

    def _clear(self) -> None:
        """``keys``: sorted hashes of the known pieces, ``slots``: their places in ``starts`` and ``unsafe``."""
        self.keys, self.slots = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(1, dtype=np.int32)
        self.unsafe = np.zeros(0, dtype=bool)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces that are new; each is encoded behind a space.  Unsafe ones get none."""
        bad = np.fromiter(map(unsafe, pieces), dtype=bool, count=len(pieces))
        good = [p for p, b in zip(pieces, bad.tolist()) if not b] if bad.any() else pieces
        lengths = np.zeros(len(pieces), dtype=np.int64)
        flat = np.zeros(0, dtype=np.uint32)
        if good:
            joined = [" " + " ".join(good[i : i + JOINED]) for i in range(0, len(good), JOINED)]
            flat = np.concatenate(self._whole(joined))
            begins = np.flatnonzero(self.opens[flat])
            if len(begins) != len(good):  # a token of a space alone: encode the pieces one by one
                each = self._whole([" " + p for p in good])
                flat, begins = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]
            lengths[~bad] = np.diff(np.append(begins, len(flat)))
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths).astype(np.int32)])
        self.unsafe = np.concatenate([self.unsafe, bad])

    def _places(self, words: A.Words) -> np.ndarray:
        """Of every piece its slot; new ones are learnt."""
        if len(self.keys) > MAX_KEPT:
            self._clear()
        keys, at, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        slots = np.empty(len(keys), dtype=np.int32)
        slots[known] = self.slots[near[known]] if len(self.keys) else 0
        if not known.all():
            fresh = at[~known]
            data = words.raw.tobytes()
            pieces = [data[a:b].decode() for a, b in zip(words.starts[fresh].tolist(), words.ends[fresh].tolist())]
            slots[~known] = len(self.unsafe) + np.arange(len(pieces))
            self._learn(pieces)
            self.keys, self.slots = np.concatenate([self.keys, keys[~known]]), np.concatenate([self.slots, slots[~known]])
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.slots = self.keys[order], self.slots[order]
        return slots[which]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets); a null is an empty text.  Give texts of a few MB at a time."""
        raw, offsets = A.texts_of(column)
        n = len(offsets) - 1
        if not self.by_piece:
            each = self._whole([t or "" for t in column.to_pylist()])
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.cumsum([0, *map(len, each)])
        words = A.Words(raw, offsets, PIECE, lower=False)
        counts, firsts = words.counts(), words.first[:-1]
        slots = self._places(words)
        spaces = np.diff(np.concatenate([[0], np.cumsum(raw == 32)])[offsets])
        # every space stands alone between two pieces, and no piece has white space at a cut
        bad = self.unsafe[slots].astype(np.int64)
        lone = counts > 0
        wrong = np.zeros(n, dtype=np.int64)
        if len(bad):
            head = bad[firsts[lone]].copy()
            bad[firsts[lone]] = 0
            wrong[lone] = np.add.reduceat(bad, firsts[lone])
            wrong[lone] += np.where(counts[lone] > 1, head, 0)
        safe = lone & (spaces == counts - 1) & (wrong == 0)
        data = raw.tobytes()
        ends_of = np.where(safe, words.ends[np.minimum(firsts, len(words) - 1)] if len(words) else 0, offsets[1:])
        # heads of safe texts, and the other texts whole
        alone = self._whole([data[a:b].decode() for a, b in zip(offsets[:-1].tolist(), ends_of.tolist())])
        inner = np.repeat(safe, counts)
        inner[firsts[lone]] = False
        mine = slots[inner]
        begin = self.starts[mine].astype(np.int64)
        length = self.starts[mine + 1] - begin
        # one gather for all pieces: within a piece the places follow each other
        ends = np.cumsum(length)
        size = int(ends[-1]) if len(ends) else 0
        body = self.flat[np.repeat(begin - (ends - length), length) + np.arange(size)]
        upto = np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], np.where(safe, counts - 1, 0)]))]
        out, sizes = [np.zeros(0, np.uint32)], []
        for k, (a, b) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist())):
            out += [alone[k], body[a:b]]
            sizes.append(len(alone[k]) + b - a)
        return np.concatenate(out), np.cumsum([0, *sizes])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_column(pa.array(texts, type=pa.string()))


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
