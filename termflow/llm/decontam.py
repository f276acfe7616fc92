"""Benchmark decontamination by pigeonhole edit matching.

A test item whose normalised text has m characters may stand in a document with up to k = floor(rate m) edits. It is cut into
k + 1 pieces: in such a place one piece is untouched, so every place is found from an exact piece hit (one
Aho-Corasick pass for all pieces) and verified by Myers' bit-parallel distance over the window around the hit.

Cases: normalised text is lower case with each run of other than letters and digits as one space; an item without letters or
digits is ignored, one too short for an edit must match exactly; null and empty texts hold nothing; equal items are all
reported; of several places the least distance, then the first, counts; repeated rows are reported as often as they stand; an
empty table on either side gives no hit; other columns stay.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edits allowed per character of the normalised item.
RATE = 0.06
#: Characters of test items searched in one pass over the documents; more are searched in further passes.
BLOCK_CHARS = 2_000_000

_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    cut = np.linspace(0, len(item), budget + 2).astype(int)
    return [(int(a), item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern: str, peq: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of the text, and the first end that has it."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # the text may start anywhere
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds a block of test items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        by: dict[str, list[int]] = {}
        for i, t in items:
            if n := normalise(t):
                by.setdefault(n, []).append(i)
        self.items = [(t, int(rate * len(t)), masks(t), sorted(ids)) for t, ids in by.items()]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (t, budget, _, _) in enumerate(self.items):
            for off, piece in pieces(t, budget):
                found.setdefault(piece, []).append((k, off))
        self.search = ahocorasick.Automaton()
        for piece, at in found.items():
            self.search.add_word(piece, (len(piece), at))
        if found:
            self.search.make_automaton()
        self.empty = not found

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) for each item that the text holds."""
        if self.empty or not text:
            return []
        norm = normalise(text)
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (size, at) in self.search.iter(norm):
            for k, off in at:
                item, budget = self.items[k][:2]
                start = last - size + 1 - off
                found.setdefault(k, []).append((max(0, start - budget), min(len(norm), start + len(item) + budget)))
        windows: dict[int, list[list[int]]] = {}
        for k, places in found.items():  # pieces that occur again give starts out of order, so windows are merged when all are known
            item, budget = self.items[k][:2]
            own = windows.setdefault(k, [])
            for lo, hi in sorted(set(places)):
                if own and lo <= own[-1][1] - len(item) + budget:
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        out = []
        for k, own in windows.items():
            item, budget, peq, ids = self.items[k]
            best, end = budget + 1, 0
            for lo, hi in own:
                part = norm[lo:hi]
                at = part.find(item)
                d, e = (0, at + len(item)) if at >= 0 else myers(item, peq, part) if budget else (1, 0)
                if d < best:
                    best, end = d, lo + e
                if best == 0:
                    break
            if best <= budget:
                out += [(i, best, end) for i in ids]
        return sorted(out)


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))


def flag(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, hits: str = "bench_hits") -> DataFrame:
    """docs with an array of the test items found in each. Items are searched in blocks of BLOCK_CHARS."""
    own = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("t")).where("item is not null and t is not null")
    docs = docs.drop(hits)
    size = own.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_CHARS))
    out = docs.withColumn(hits, F.lit(None).cast(HITS)) if not size else docs
    for b in range(n if size else 0):
        block = [(r[0], r[1]) for r in own.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b).collect()]
        out = _pass(out, block, text, rate, hits)
    return out.withColumn(hits, F.coalesce(F.col(hits), F.array().cast(HITS)))


def _pass(docs: DataFrame, block: list[tuple[int, str]], text: str, rate: float, hits: str) -> DataFrame:
    shared, names, first = docs.sparkSession.sparkContext.broadcast(block), docs.columns, hits not in docs.columns
    at = names.index(text)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value, rate)
        for b in batches:
            new = [[{"item_id": i, "distance": d, "end": e} for i, d, e in m.hits(t)] for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            if not first:
                new = [(o or []) + x for o, x in zip(columns[names.index(hits)].to_pylist(), new, strict=True)]
                columns[names.index(hits)] = pa.array(new, _ARROW_HITS)
            yield pa.RecordBatch.from_arrays(columns if not first else [*columns, pa.array(new, _ARROW_HITS)], names if not first else [*names, hits])

    return docs.mapInArrow(job, docs.schema if not first else T.StructType([*docs.schema.fields, T.StructField(hits, HITS)]))
