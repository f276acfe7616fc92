"""SimHash near duplicates: fingerprints of word shingles, linked within a few bits by tiled exact comparison.

Equal fingerprints are one node. Nodes lie in cells by the population counts of their four 16-bit quarters; two fingerprints
within the radius have counts that differ by no more than the radius in all, so only cells that near are compared and
all other tile pairs are skipped. A cell is cut into tiles of bounded size. A task compares two tiles by exclusive-or and bit
counts in numpy and returns only a spanning forest of the links it finds: links are never expanded inside a dense group.
Star contraction joins the forests into components.

Cases: a null or empty text has fingerprint zero and is linked like any other; a row without id is linked and may join two classes,
but gives a class its name only if no row of the class has an id (then null); rows of one id are nodes of their own; repeated rows stay; an empty
table gives an empty result; a long text is hashed in pieces; other columns take no part.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termflow.llm import graph
from termflow.session import materialize

WORDS, SEED, RADIUS = 3, 42, 3
#: Cells are keyed by the counts of so many equal parts of the 64 bits.
PARTS = 4
#: Fingerprints of a tile, on average; fingerprints compared at a time; shingles hashed at a time.
TILE, BLOCK, CHUNK = 4096, 512, 1 << 15


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits; bit i is set if it is in over half of the shingles' XXH64. Words are parted by ASCII white space, A-Z lower-cased."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(w) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(w)) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[i:i + CHUNK], last[i:i + CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long of the same bits."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("id"), pa.array(fp)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(job, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def cell_of(fp: Column) -> Column:
    """Population counts of the parts as one number in base 65."""
    width = 64 // PARTS
    out = F.lit(0)
    for i in range(PARTS):
        out = out * 65 + F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return out.cast("int")


def steps(radius: int) -> list[int]:
    """Differences of cell numbers to cells at most `radius` away in all counts together: the cell itself and one of each opposite pair."""
    moves = itertools.product(range(-radius, radius + 1), repeat=PARTS)
    code = [sum(m * 65 ** (PARTS - 1 - i) for i, m in enumerate(v)) for v in moves if sum(map(abs, v)) <= radius]
    return sorted(c for c in code if c >= 0)


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (unsigned fingerprints), each tree as a star about its least member."""
    found = []
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            near = np.bitwise_count(a[i:i + BLOCK, None] ^ b[None, j:j + BLOCK]) <= radius
            if near.any():
                x, y = np.nonzero(near)
                x, y = a[i + x], b[j + y]
                keep = x != y
                if keep.any():
                    found.append(stars(x[keep], y[keep]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return stars(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to (member, least member of its tree), by hooking on the lesser label and jumping pointers."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = at[:len(x)], at[len(x):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints (column fp) which a chain of links within the radius connects."""
    placed = nodes.select("fp", cell_of(F.col("fp")).alias("cell"))
    cells = materialize(placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")), "simhash-cells")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = placed.join(cells, "cell").groupBy("cell", part.alias("part")).agg(F.collect_list("fp").alias("fps"))  # about `tile` rows each
    tiles = materialize(tiles, "simhash-tiles")
    known = cells.select(F.col("cell").alias("to_cell"))
    pairs = cells.select("cell", F.explode(F.array(*[F.col("cell") + c for c in steps(radius)])).alias("to_cell")).join(known, "to_cell")
    left = tiles.join(pairs, "cell")
    right = tiles.select(F.col("cell").alias("to_cell"), F.col("part").alias("to_part"), F.col("fps").alias("to_fps"))
    once = (F.col("cell") < F.col("to_cell")) | (F.col("part") <= F.col("to_part"))
    met = left.join(right, "to_cell").where(once).select("fps", "to_fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            a, b = batch.column("fps"), batch.column("to_fps")
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (a, b))
                kept.append(forest(x, y, radius))
            yield pa.record_batch([pa.array(np.concatenate([k[s] for k in kept]).view(np.int64)) for s in (0, 1)], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): component is the least id of all rows that links reach."""
    rows = materialize(fingerprints(docs, id_col, text), "simhash-fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = materialize(graph.components(materialize(links(nodes, radius), "simhash-links")), "simhash-roots")
    named = nodes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    known = materialize(named.join(names, "root").select("fp", "component"), "simhash-names")
    return rows.join(known, "fp").select("id", "fp", "component")
