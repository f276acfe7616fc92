"""Texts as byte arrays: token and shingle hashes for whole Arrow batches without a Python loop over words."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; a longer text is handled alone.
BLOCK_BYTES = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))

_CLASS = np.full(256, 2, np.int8)  # punctuation
_CLASS[[9, 10, 11, 12, 13, 32, 0]] = 0  # white space
_CLASS[128:] = 1
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    _CLASS[_c] = 1

_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = True, tail: str = "\n") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of about BLOCK_BYTES each; every text ends with `tail`. Null is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        at = 0
        lengths = pc.fill_null(pc.binary_length(chunk), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        while at < len(chunk):
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
            part = pc.fill_null(chunk.slice(at, end - at), "").cast(pa.large_string())
            if lower:
                part = pc.utf8_lower(part)
            if tail:
                part = pc.binary_join_element_wise(part, pa.scalar("", pa.large_string()), pa.scalar(tail, pa.large_string()))
            _, off, data = part.buffers()
            off = np.frombuffer(off, np.int64)[part.offset:part.offset + len(part) + 1]
            data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
            yield base + at, base + end, data, off - off[0]
            at = end
        base += len(chunk)


def tokens(data: np.ndarray, off: np.ndarray, punctuation: bool = False) -> dict[str, np.ndarray]:
    """Words (and runs of punctuation) of a block whose texts end with white space: start, end, row, hash; sums for prefixes."""
    kind = _CLASS[data]
    if not punctuation:
        kind = kind & 1
    change = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
    inside = kind[change[:-1]] if len(change) else change
    start, end = change[:-1][inside > 0], change[1:][inside > 0]
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return {"start": start, "end": end, "row": np.searchsorted(off, start, "right") - 1, "sums": sums, "inverse": inverse,
            "hash": mix((sums[end] - sums[start]) * inverse[start])}


def prefixes(t: dict[str, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words of at least `size` bytes, and the hash of their first `size` bytes."""
    at = np.flatnonzero(t["end"] - t["start"] >= size)
    s = t["start"][at]
    return at, mix(((t["sums"][s + size] - t["sums"][s]) * t["inverse"][s]) + np.uint64(size * int(_MULT) & 0xFFFFFFFFFFFFFFFF))


def shingles(word: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `size` words of a row; rows with fewer words give one shingle of all they have."""
    n = len(word)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for j in range(size):
        acc[:n - j] = acc[:n - j] * _BASE + word[j:] if j else word
    # the last size-1 runs reach past the end of the block or of the row
    first = np.flatnonzero(np.diff(row, prepend=-1))
    last = np.append(first[1:], n)
    length = np.repeat(last - first, last - first)
    left = np.repeat(last, last - first) - np.arange(n)
    full = left >= size
    out_h, out_r = mix(acc[full]), row[full]
    few = first[(last - first) < size]
    if len(few):
        short = []
        for i in few:
            h = np.uint64(length[i])
            for w in word[i:i + int(length[i])]:
                h = np.uint64((int(h) * int(_BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            short.append(h)
        out_h, out_r = np.concatenate([out_h, mix(np.array(short, np.uint64))]), np.concatenate([out_r, row[few]])
        order = np.argsort(out_r, kind="stable")
        out_h, out_r = out_h[order], out_r[order]
    return out_h, out_r


class HashIndex:
    """Sorted 64-bit hashes with an index on their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(8, min(22, int(np.ceil(np.log2(len(hashes) + 1))) + 3))
        self.shift = np.uint64(64 - bits)
        lead = (hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.int32)
        self.run = int(np.max(np.diff(self.first))) if len(hashes) else 0
        self.padded = np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 if absent."""
        at = self.first[(h >> self.shift).astype(np.int64)]
        for _ in range(self.run):
            at = at + (self.padded[at] < h)
            np.minimum(at, len(self.hashes), out=at)
        hit = (self.padded[at] == h) & (at < len(self.hashes))
        return np.where(hit, at, -1)
