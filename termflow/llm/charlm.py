"""Character n-grams of folded text, counted by Spark tasks and merged by key."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands between texts; a private-use code point.
EDGE = 0xE000
SPACE = 32
BLOCK_CHARS = 1 << 18
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> folded 16-bit symbol: lower-case letters and marks stay, all else is a space."""
    if not _FOLD:
        t = np.full(0x110000, SPACE, np.uint16)
        for c in range(0x10000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
            elif 0x300 <= c < 0x370:
                t[c] = c
        rare = np.fromiter((chr(c).isalpha() for c in range(0x10000, 0x110000)), bool, 0x100000)
        t[0x10000:] = np.where(rare, 0xF000 + np.arange(0x100000) % 255, SPACE)  # letters of rarer planes share classes
        t[EDGE] = EDGE
        _FOLD.append(t)
    return _FOLD[0]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def folded(texts: list[str | None], order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, symbols, positions where each text starts); every text follows order-1 edges, runs of space are one."""
    table, pad, at = fold_table(), chr(EDGE) * (order - 1), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= BLOCK_CHARS):
            size += len(texts[end] or "")
            end += 1
        joined = "".join([pad + (t or "") for t in texts[at:end]]) + " "
        c = table[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
        lengths = np.array([len(t or "") + order - 1 for t in texts[at:end]], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        kept = np.concatenate([[0], np.cumsum(keep)])
        yield at, end, c[keep], kept[starts]
        at = end


def grams(c: np.ndarray, order: int) -> np.ndarray:
    """Packed n-gram that ends at each position from order-1 on."""
    n = len(c) - order + 1
    key = np.zeros(max(n, 0), np.uint64)
    for j in range(order):
        key = (key << np.uint64(16)) | c[j:j + n].astype(np.uint64)
    return key


def count_grams(docs: DataFrame, text: str, group: str, order: int) -> DataFrame:
    """(grp, key, n): n-grams of every text by group, summed in each task before the shuffle."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
            k = np.concatenate([p[0] for p in parts])
            u, inv = np.unique(k, return_inverse=True)
            return u, np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for g, parts in held.items():
                u, n = merge(parts)
                for i in range(0, len(u), 100_000):
                    m = len(u[i:i + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array([g] * m), pa.array(u[i:i + m].view(np.int64)), pa.array(n[i:i + m])], ["grp", "key", "n"])
            held.clear()

        for b in batches:
            by: dict[str, list[str]] = {}
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    by.setdefault(g, []).append(t)
            for g, texts in by.items():
                for _, _, c, _ in folded(texts, order):
                    k = grams(c, order)
                    u, n = np.unique(k[(k & np.uint64(0xFFFF)) != np.uint64(EDGE)], return_counts=True)
                    held.setdefault(g, []).append((u, n))
                    size += len(u)
                    if size > 1_000_000:
                        for x in list(held):
                            held[x] = [merge(held[x])]
                        size = sum(len(p[0]) for ps in held.values() for p in ps)
                        if size > 800_000:  # too many different n-grams for one task: pass them on and start again
                            yield from flush()
                            size = 0
        yield from flush()

    part = docs.select(F.col(group).alias("grp"), F.col(text).alias("text")).mapInArrow(job, "grp string, key long, n long")
    return part.groupBy("grp", "key").agg(F.sum("n").alias("n"))


Scorer = Callable[[list[str | None]], np.ndarray]
