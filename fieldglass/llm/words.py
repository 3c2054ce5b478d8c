"""Vectorised splitting and hashing of the words of a batch of UTF-8 texts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at once; a longer text is worked on whole.
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The low n bytes of a word.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n - 1 modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        step = np.full(size, U(_BASE))
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(_BASE) + U(seed)) | U(1)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def spans(kept: np.ndarray, at: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of kept bytes that cross no row's bounds: starts, lengths, and the first run of each row (with an end).

    cut: true where a run has to begin anew.
    """
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    inner = at[:-1][at[:-1] < len(kept)]
    first[inner] = kept[inner]
    if cut is not None:
        first |= cut & kept
    starts = np.flatnonzero(first)
    where = np.flatnonzero(kept)
    begin = np.searchsorted(where, starts) if len(starts) else np.zeros(0, np.int64)
    return starts, np.diff(begin, append=len(where)), np.searchsorted(starts, at)


def word_values(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (low, high) for each run of bytes: a word of up to 15 bytes itself with its length, else its BLAKE2b."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    low = eight[starts] & _MASKS[np.minimum(lengths, 8)]
    high = eight[starts + 8] & _MASKS[np.clip(lengths - 8, 0, 7)] | lengths.astype(U) << U(56)
    long = np.flatnonzero(lengths >= 16)
    if len(long):
        raw, begin = memoryview(np.ascontiguousarray(data)), starts[long].tolist()
        digests = b"".join(blake2b(raw[a : a + n], digest_size=16).digest() for a, n in zip(begin, lengths[long].tolist(), strict=True))
        pair = np.frombuffer(digests, "<u8").reshape(-1, 2)
        low[long], high[long] = pair[:, 0], pair[:, 1] | U(0xFF << 56)
    return low, high


def fold(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 128-bit values, in which either half is multiplied into the other before both are mixed."""
    return mix(mix(low ^ high * U(0xD6E8FEB86659FD93)) + mix(high + low * U(0xA0761D6478BD642F)) * U(0xE7037ED1A0B428DB))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: hashes, starts, lengths in bytes, and each row's first word."""
    kept = ~SPACE[data]
    starts, lengths, row = spans(kept, at)
    return fold(*word_values(LOWER[data], starts, lengths)), starts, lengths, row


def windows(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every `width` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for i, c in enumerate(constants(width, seed)):
        out += values[i : i + n] * c
    return mix(out)


class Numbering:
    """Numbers 0, 1, ... for keys of one or two 64-bit parts, by a hash table that is asked for many keys at once."""

    def __init__(self, parts: int = 1):
        self.n = 0
        self.keys = [np.zeros(1 << 12, U) for _ in range(parts)]
        self.slots = np.full(1 << 14, -1, np.int32)

    def _first(self, parts: list[np.ndarray]) -> np.ndarray:
        h = fold(*parts) if len(parts) > 1 else mix(parts[0])
        return (h & U(len(self.slots) - 1)).astype(np.int64)

    def find(self, *parts: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it isn't known."""
        slot, out, todo = self._first(list(parts)), np.full(len(parts[0]), -1, np.int64), None
        while todo is None or len(todo):
            there = self.slots[slot]
            asked = parts if todo is None else [x[todo] for x in parts]
            hit = there >= 0
            for own, x in zip(self.keys, asked, strict=True):
                hit &= own[there] == x
            todo = np.arange(len(out)) if todo is None else todo
            out[todo[hit]] = there[hit]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out

    def add(self, *parts: np.ndarray) -> None:
        """Number distinct keys that aren't known yet."""
        new = np.arange(self.n, self.n + len(parts[0]))
        self.n += len(new)
        if self.n > len(self.keys[0]):
            self.keys = [np.concatenate([x, np.zeros(2 * self.n - len(x), U)]) for x in self.keys]
        for own, x in zip(self.keys, parts, strict=True):
            own[new] = x
        if 5 * self.n > 2 * len(self.slots):
            self.slots = np.full(1 << int(5 * self.n).bit_length(), -1, np.int32)
            new = np.arange(self.n)
        slot = self._first([x[new] for x in self.keys])
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            lost = self.slots[slot] != new
            new, slot = new[lost], (slot[lost] + 1) & (len(self.slots) - 1)
