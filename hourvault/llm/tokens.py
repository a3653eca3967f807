"""Token ids of whole texts by a public tokenizer file, in batches and with a word cache.

A byte-level BPE with the usual pattern never joins bytes across the end of a
run of non-white characters, so a text may be cut before any white space that
follows a character that is not white, and before an ASCII sign (other than the
apostrophe) that follows an ASCII letter or digit. The ids of the pieces,
end to end, are the ids of the text. Most pieces repeat, so each worker keeps
the ids of those it has seen, by a 64-bit hash, up to a fixed number of them;
the tokenizer encodes the others.
"""

from __future__ import annotations

import os

import numpy as np

from hourvault.llm.flat import U64, byte_set, ragged, span_hashes
from hourvault.llm.worker import kept

#: Pieces a worker keeps; the table of slots has room for twice as many. About 70 MB.
CACHE_PIECES = 1 << 20

_SPACE = byte_set((9, 13), (32, 32))
_ALNUM = byte_set((48, 57), (65, 90), (97, 122))
# Without the bar, so that the name of a special token stays in one piece.
_SIGN = byte_set((33, 38), (40, 47), (58, 64), (91, 96), (123, 123), (125, 126))
# The first byte of UTF-8 characters of three bytes among which white ones are.
_WIDE = byte_set((0xE1, 0xE3))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text, and at each place where a cut is safe."""
    n = len(data)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    before, after = data[:-1], data[1:]
    cut[1:n] = (space[1:] & ~space[:-1] & (before < 0x1C)) | (space[1:] & ~space[:-1] & (before > 0x1F))
    cut[1:n] |= _SIGN[after] & _ALNUM[before]
    # White characters outside ASCII end in bytes from 0x80; leave those places uncut.
    odd = np.flatnonzero(cut[1:n] & (before >= 0x80)) + 1
    if len(odd):
        two = data[odd - 2] if n > 1 else data[odd]
        three = data[np.maximum(odd - 3, 0)]
        white = ((two == 0xC2) & ((data[odd - 1] == 0x85) | (data[odd - 1] == 0xA0))) | _WIDE[three]
        cut[odd[white]] = False
    cut[offsets[:-1]] = True
    cut = cut[:n]
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts, with the pieces seen so far in an open-addressed table of numpy arrays."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.most = cache_pieces
        self.mask = U64(2 * cache_pieces - 1)
        self.clear()

    def clear(self) -> None:
        slots = int(self.mask) + 1
        self.keys = np.zeros(slots, U64)
        self.begin = np.zeros(slots, np.int32)
        self.count = np.zeros(slots, np.int32)
        self.pool = np.zeros(1 << 20, self.dtype)
        self.used, self.pieces = 0, 0

    def slots_of(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not there."""
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        at = (keys & self.mask).astype(np.int64)
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            found[todo[hit]] = at[hit]
            on = ~hit & (held != 0)
            todo, at = todo[on], (at[on] + 1) & int(self.mask)
        return found

    def insert(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        begins = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.pieces += len(keys)
        todo, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(todo):
            free = self.keys[at] == 0
            # The first of those that want a free slot gets it.
            _, winner = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            winner = winner[free[winner]]
            self.keys[at[winner]] = keys[todo[winner]]
            self.begin[at[winner]] = begins[todo[winner]]
            self.count[at[winner]] = counts[todo[winner]]
            left = np.ones(len(todo), bool)
            left[winner] = False
            todo, at = todo[left], (at[left] + 1) & int(self.mask)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = [], []
        for first in range(0, len(pieces), 4096):
            for encoding in self.tokenizer.encode_batch_fast(pieces[first : first + 4096], add_special_tokens=False):
                found = encoding.ids
                counts.append(len(found))
                ids.extend(found)
        return np.array(counts, np.int64), np.array(ids, self.dtype)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets into them."""
        if len(data) == 0:
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        offsets = offsets.astype(np.int64)
        full = np.flatnonzero(np.diff(offsets) > 0)
        starts = cut_points(data, offsets[np.append(full, len(offsets) - 1)])
        ends = np.append(starts[1:], len(data))
        keys = span_hashes(data, starts, ends)
        keys[keys == 0] = U64(1)
        slots = self.slots_of(keys)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new, at = np.unique(keys[missing], return_index=True)
            if self.pieces + len(new) > self.most:
                self.clear()
                new, at = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            if len(new) > self.most:  # more pieces in one batch than the table holds
                return self._plain(data, offsets)
            raw, where = data.tobytes(), missing[at]
            texts = [raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            self.insert(new, *self.encode_pieces(texts))
            slots[missing] = self.slots_of(keys[missing])
        counts = self.count[slots].astype(np.int64)
        ids = self.pool[ragged(self.begin[slots].astype(np.int64), counts)]
        running = np.concatenate([[0], np.cumsum(counts)])
        return ids, running[np.searchsorted(starts, offsets, side="left")]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        counts, ids = self.encode_pieces(texts)
        return ids, np.concatenate([[0], np.cumsum(counts)])


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    path = path or default_tokenizer()
    return kept(("encoder", path), lambda: Encoder(path))
