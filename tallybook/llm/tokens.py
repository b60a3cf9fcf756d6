"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker while it is remembered.

The vocabularies meant here lower-case, drop white space and split runs of letters, single digits and runs of other signs
before they merge, so a text's ids are those of its parts one after the other. Words of ASCII and Latin-1 letters are cut into
these parts here; a word with anything else (other scripts, combining marks, apostrophes, "<", control bytes) is given to the library
as it is. The library encodes every part.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tallybook.llm.words import LOWER, groups, range_hashes, utf8, words_of

SLOTS = 1 << 20
ENTRIES = 1 << 19
"""A worker forgets its words when it holds this many, so its memory is bounded (some 30 MB)."""
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[128:] = _LETTER  # counts only in words of Latin-1 letters
_CLASS[48:58] = _DIGIT
_ODD = np.zeros(256, bool)
_ODD[[*range(0x20), 0x27, 0x3C, 0x7F]] = True
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self, needed: int = 0) -> None:
        """Start anew, with room for ``needed`` words of one group of texts."""
        self.slot_hash = np.zeros(SLOTS, np.uint64)
        self.slot_entry = np.full(SLOTS, -1, np.int32)
        self.start = np.zeros(max(ENTRIES, needed), np.int64)
        self.length = np.zeros(max(ENTRIES, needed), np.int32)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.entries = self.used = 0

    def learn(self, hashes: np.ndarray, parts: list[bytes], odd: np.ndarray) -> np.ndarray:
        """Entries of new parts; odd ones are encoded alone, the others in one go, divided where a token ends a word."""
        out = np.zeros(len(parts), np.int32)
        plain = np.flatnonzero(~odd)
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        texts = [b" ".join([parts[k] for k in plain[c : c + 200].tolist()]).decode() for c in range(0, len(plain), 200)]
        for c, found in enumerate(self.library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            rows = plain[200 * c : 200 * c + 200]
            if len(stop) != len(rows):
                raise ValueError("a word was not encoded as one part")
            pieces.append((rows, ids, np.diff(stop, prepend=0)))
        for row in np.flatnonzero(odd).tolist():
            ids = np.array(self.library.encode(parts[row].decode(), add_special_tokens=False).ids, np.uint32)
            pieces.append((np.array([row]), ids, np.array([len(ids)])))
        for rows, ids, lengths in pieces:
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            entries = np.arange(self.entries, self.entries + len(rows))
            self.start[entries] = self.used + np.cumsum(lengths) - lengths
            self.length[entries] = lengths
            out[rows] = entries
            self.entries += len(rows)
            self.used += len(ids)
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        self.slot_hash[slots] = hashes
        self.slot_entry[slots] = out
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one text after the other, and the number of each."""
        words = words_of(data, offsets)
        data = words.data
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        second = np.zeros(len(data), bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        lead = np.zeros(len(data), bool)
        lead[:-1] = second[1:]
        odd = _ODD[data] | ((data >= 0x80) & ~second & ~lead)
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(odd, out=before[1:])
        odd_word = before[words.end] > before[words.start]
        # odd counts white space as well, but a word holds none
        mark = np.zeros(len(data) + 1, np.int8)
        mark[words.start] += 1
        mark[words.end] -= 1
        inside = np.cumsum(mark[:-1], dtype=np.int8) > 0  # words of neighbouring texts may touch: then it stays 1
        kind = _CLASS[data]
        lowered = LOWER[data]
        upper = second & (data <= 0x9E)
        lowered[upper] += 0x20
        first = np.zeros(len(data) + 1, bool)
        first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        first[:-1] &= inside
        if odd_word.any():
            for a, b in zip(words.start[odd_word].tolist(), words.end[odd_word].tolist()):
                first[a:b] = False
                lowered[a:b] = data[a:b]
        first[words.start] = True
        start = np.flatnonzero(first[:-1])
        first[words.end] = True
        end = np.flatnonzero(first[1:]) + 1
        end = end[np.searchsorted(end, start, "right")]
        hashes = range_hashes(lowered, start, end)
        if self.entries + len(hashes) > ENTRIES and self.entries + len(np.unique(hashes)) > ENTRIES:
            self.forget(len(hashes))
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        entry = self.slot_entry[slots]
        new = np.flatnonzero((self.slot_hash[slots] != hashes) | (entry < 0))
        if len(new):
            found, index, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[index]
            buffer = lowered.tobytes()
            parts = [buffer[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            odd_part = odd_word[np.searchsorted(words.start, start[at], "right") - 1]
            entry[new] = self.learn(found, parts, odd_part)[inverse.ravel()]
        length = self.length[entry].astype(np.int64)
        before = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=before[1:])
        ids = self.ids[np.repeat(self.start[entry] - before[:-1], length) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(start, offsets - offsets[0])])


def encode_column(column: pa.Array, path: str):
    """(ids, counts) of consecutive groups of a column's texts; null counts as empty."""
    data, offsets = utf8(column)
    known = encoder(path)
    for i, j in groups(offsets):
        yield known.encode(data, offsets[i : j + 1])
