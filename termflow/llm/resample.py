"""Quality selection by importance resampling.

Two hashed n-gram bag models are fitted: one to the target texts (labelled of good quality), one to all raw texts. A
document's log-weight is the sum over its word and word-pair features of the log ratio of the two. Gumbel noise
keyed by the document id is added and the top k are kept: a sample without replacement in proportion to the weights.

Cases: a null or empty text has no feature and weight 0 (ratio 1); equal keys are ordered by id; repeated rows have equal
keys and count as rows of their own; with no target row every weight is 0 and the sample is uniform; an empty table gives an
empty result; other columns stay.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termflow.llm.textarr import blocks, mix, tokens
from termflow.session import materialize

#: Hash cells of the n-gram models.
CELLS = 1 << 14
#: Labelled rows the target model is fitted on, drawn by hash (all, if fewer): so many ids go to every task. The raw model has all rows.
TARGET_ROWS = 24_000
#: Share of the rows kept.
KEEP = 0.5
SEED = 20
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _features(data: np.ndarray, off: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of each word or punctuation run and of each neighbouring pair within a text."""
    t = tokens(data, off, punctuation=True)
    h, row = t["hash"], t["row"]
    same = row[1:] == row[:-1]
    pair = mix(h[:-1] * _PAIR + h[1:])[same]
    return np.concatenate([row, row[1:][same]]), (np.concatenate([h, pair]) & np.uint64(cells - 1)).astype(np.int64)


def cell_counts(docs: DataFrame, text: str, target: str, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts of the target rows and of all rows; each task sends one fixed-size vector of each."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells), np.int64)
        for b in batches:
            good = np.array(b.column(1).to_pylist(), bool)
            for first, _, data, off in blocks(b.column(0)):
                row, cell = _features(data, off, cells)
                total[1] += np.bincount(cell, minlength=cells)
                total[0] += np.bincount(cell[good[first + row]], minlength=cells)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["cell", "good", "raw"])

    part = docs.select(text, F.coalesce(F.col(target), F.lit(False)).alias("good")).mapInArrow(job, "cell long, good long, raw long")
    t = part.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).toArrow()
    out = np.zeros((2, cells), np.int64)
    if t.num_rows:
        at = t.column("cell").to_numpy()
        out[0][at], out[1][at] = t.column("good").to_numpy(), t.column("raw").to_numpy()
    return out[0], out[1]


def log_ratio(good: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the target's over the raw texts' feature probability; 0 everywhere if there is no target."""
    if not good.sum() or not raw.sum():
        return np.zeros(len(raw))
    return np.log((good + smooth) / (good.sum() + smooth * len(good))) - np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))


def weigh(docs: DataFrame, text: str, ratio: np.ndarray) -> DataFrame:
    """docs with log_weight and n_features; columns of these names are replaced."""
    docs = docs.drop("log_weight", "n_features")
    shared, at, cells = docs.sparkSession.sparkContext.broadcast(ratio), docs.columns.index(text), len(ratio)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for first, end, data, off in blocks(b.column(at)):
                row, cell = _features(data, off, cells)
                w[first:end] = np.bincount(row, weights=shared.value[cell], minlength=end - first)
                n[first:end] = np.bincount(row, minlength=end - first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w), pa.array(n)], [*b.schema.names, "log_weight", "n_features"])

    return docs.mapInArrow(job, T.StructType([*docs.schema.fields, T.StructField("log_weight", T.DoubleType()), T.StructField("n_features", T.LongType())]))


def with_gumbel(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """df with gumbel_key: log_weight plus standard Gumbel noise that the id and the seed fix."""
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return df.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))


def top_k(df: DataFrame, key: str, tie: str, k: int, cells: int = 4096, alone: int = 20_000) -> DataFrame:
    """df with `selected`: the k rows of the largest key. Counts by key range close in on the k-th; only its narrow range is sorted."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if n == 0 or k <= 0:
        return df.withColumn("selected", F.lit(False))
    if k >= n:
        return df.withColumn("selected", F.lit(True))
    above = 0
    while n > alone and high > low:
        width = (high - low) / cells
        cell = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(cells - 1))
        inside = (F.col(key) >= low) & (F.col(key) <= high)
        found = sorted(df.where(inside).groupBy(cell.alias("cell")).agg(F.count("*"), F.min(key), F.max(key)).collect(), reverse=True)
        for _, m, lo, hi in found:
            if above + m >= k:
                step, low, high, n = (lo, hi) != (low, high), lo, hi, m
                break
            above += m
        if not step:
            break
    inside = (F.col(key) >= low) & (F.col(key) <= high)
    ranked = df.where(inside).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(key), F.asc(tie)))).withColumn("selected", F.col("_rank") <= k - above).drop("_rank")
    return df.where(~inside).withColumn("selected", F.col(key) > high).unionByName(ranked)


def resample(docs: DataFrame, targets: DataFrame, text: str = "text", id_col: str = "doc_id", keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """docs without the text, with log_weight, n_features, gumbel_key and selected; round(keep x rows) are selected. targets: ids of good texts."""
    good = targets.select(id_col).distinct().orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(TARGET_ROWS).withColumn("is_target", F.lit(True))
    counts = cell_counts(docs.select(id_col, text).join(F.broadcast(good), id_col, "left"), text, "is_target")
    scored = weigh(docs, text, log_ratio(*counts)).drop(text)
    scored = materialize(with_gumbel(scored, id_col, seed), "resample")
    return top_k(scored, "gumbel_key", id_col, round(keep * scored.count()))
