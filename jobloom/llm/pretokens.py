"""Pre-tokens of byte-level BPE for whole batches, and a store of encoded pre-tokens.

The split is the public byte-level pattern
``'(?:s|t|re|ve|m|ll|d)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Texts of ASCII and of the two-byte letters U+00C0 to U+027F, without contractions
and special tokens, are split for the whole batch at once from byte classes; all
other texts go through the pattern itself, one by one. Both give the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from jobloom.llm.kernels import Hashes, ragged

PATTERN = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WS, LETTER, DIGIT, OTHER, ODD = 0, 1, 2, 3, 4
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = WS
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[0x80:0xC0] = LETTER  # the second byte of a two-byte letter
_CLASS[0xC0:] = ODD
_CLASS[0xC3:0xCA] = LETTER
_CONTRACTED = np.zeros(256, bool)
_CONTRACTED[[ord(c) for c in "strvmld"]] = True


def split_text(text: str, special: str | None) -> list[str]:
    """Pre-tokens of one text; the special token's string is one of its own."""
    out: list[str] = []
    for i, part in enumerate(text.split(special) if special else [text]):
        if i:
            out.append(special)
        out += PATTERN.findall(part)
    return out


def _odd_rows(data: np.ndarray, off: np.ndarray, cls: np.ndarray, special: str | None) -> np.ndarray:
    """Rows that need the pattern itself."""
    bad = cls == ODD
    nxt = data[1:]
    bad[:-1] |= (data[:-1] == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7))
    bad[:-1] |= (data[:-1] == 0x27) & _CONTRACTED[nxt]
    if special:
        first = special.encode()
        for at in np.flatnonzero(data == first[0]):
            if bytes(data[at : at + len(first)]) == first:
                bad[at] = True
    at = np.flatnonzero(bad)
    return np.unique(np.searchsorted(off, at, "right") - 1)


def starts(data: np.ndarray, off: np.ndarray, special: str | None = None) -> np.ndarray:
    """Where pre-tokens start; each ends where the next starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cls = _CLASS[data]
    odd = _odd_rows(data, off, cls, special)
    ws = cls == WS
    flag = np.empty(n, bool)
    # A start: a class unlike the one before, but not after a blank; of white space, its first and the last before something else.
    flag[0] = True
    flag[1:] = np.where(ws[1:], ~ws[:-1], (cls[1:] != cls[:-1]) & (data[:-1] != 0x20))
    flag[:-1] |= ws[:-1] & ~ws[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    ends = off[1:][off[:-1] < off[1:]] - 1
    # At a text's end a run of white space is one; the rule above saw the next text's first byte.
    tail = ends[ws[ends]]
    tail = tail[tail > 0]
    flag[tail] = ~ws[tail - 1]
    flag[heads] = True
    if not len(odd):
        return np.flatnonzero(flag)
    for row in odd:
        a, b = off[row], off[row + 1]
        flag[a:b] = False
        at = a
        for piece in split_text(bytes(data[a:b]).decode("utf-8", "replace"), special):
            flag[at] = True
            at += len(piece.encode())
    return np.flatnonzero(flag)


class Store:
    """Ids of pre-tokens by their 64-bit hash; keeps the first ``most`` that it meets, which the frequent ones are among."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def batch(self, data: np.ndarray, off: np.ndarray, special: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        begin = starts(data, off, special)
        end = np.append(begin[1:], len(data))
        key, first, inverse = np.unique(Hashes(data).of(begin, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        known = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        new = np.flatnonzero(~known)
        ids, size = self.encode(data, begin[first[new]], end[first[new]])
        at = np.empty(len(key), np.int64)
        count = np.empty(len(key), np.int64)
        base = len(self.ids)
        at[known], count[known] = self.at[place[known]], self.size[place[known]]
        at[new], count[new] = base + np.cumsum(size) - size, size
        every = np.concatenate([self.ids, ids])
        if len(self.keys) < self.most and len(new):
            self.ids = every
            where = np.searchsorted(self.keys, key[new])
            self.keys, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.keys, key[new]), (self.at, at[new]), (self.size, count[new])))
        size = count[inverse]
        out = every[ragged(at[inverse], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        bounds = total[np.searchsorted(begin, off)]
        return out, np.diff(bounds)
