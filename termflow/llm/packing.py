"""Best-fit packing of documents into training sequences under conflict constraints.

Documents longer than a sequence are cut; the pieces of a shard are placed in order of falling length. Bins are held in order
of their residual room, each with a bitmap of the sources and one of the duplicate clusters inside. The search starts at the
smallest room that fits and goes on to the next larger one until a bin is compatible, so the piece lands in the tightest
bin without a conflict, else in a new bin. Shards are drawn by hash and of bounded size, so a hot source is spread over all.

Cases: a null or empty text needs no room and has a null bin; a null source or cluster conflicts with none; ties go to the older
bin, equal lengths to the smaller id; repeated rows are pieces of one cluster and never share a bin; an empty table gives an empty
result; other columns take no part.
"""
from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termflow.session import materialize

#: Characters of a sequence.
CAPACITY = 8192
#: Pieces packed together, on average.
SHARD_PIECES = 4096


def best_fit(length: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, given in order of falling length. Codes below 0 conflict with none."""
    bins: list[tuple[int, int]] = []  # (room, bin), rising
    used, sources, clusters = [], [], []
    where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for i, (n, s, c) in enumerate(zip(length.tolist(), source.tolist(), cluster.tolist(), strict=True)):
        sbit, cbit = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        at = bisect_left(bins, (n, -1))
        while at < len(bins) and (sources[bins[at][1]] & sbit or clusters[bins[at][1]] & cbit):
            at += 1
        if at < len(bins):
            room, b = bins.pop(at)
        else:
            room, b = capacity, len(used)
            used.append(0)
            sources.append(0)
            clusters.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += n
        sources[b] |= sbit
        clusters[b] |= cbit
        if room > n:
            insort(bins, (room - n, b))
    return where, offset


def codes(values: pd.Series) -> np.ndarray:
    """Small codes of the values that stand more than once, -1 for the others and for null."""
    code, kinds = pd.factorize(values)
    many = np.bincount(code[code >= 0], minlength=len(kinds)) > 1
    small = np.where(many, np.cumsum(many) - 1, -1)
    return np.where(code >= 0, small[code] if len(kinds) else -1, -1)


def pack(items: DataFrame, id_col: str = "doc_id", source: str = "source", cluster: str = "cluster", length: str = "n_chars", capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """items (id, source, cluster, length) to (id, cluster, piece, start, n_chars, bin_id, bin_offset): one row per piece."""
    base = items.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("len"))
    last = F.greatest(F.ceil(F.col("len") / capacity).cast("long") - 1, F.lit(0))
    pieces = base.select("doc_id", "source", "cluster", "len", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("n", F.least(F.col("len") - F.col("start"), F.lit(capacity))).drop("len")
    pieces = materialize(pieces, "packing-pieces")
    shards = max(1, -(-pieces.where("n > 0").count() // shard_pieces))
    schema = "doc_id long, cluster string, piece long, start long, n_chars long, bin_id long, bin_offset long"

    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable")
        b, off = best_fit(pdf["n"].to_numpy(), codes(pdf["source"]), codes(pdf["cluster"]), capacity)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "cluster": pdf["cluster"], "piece": pdf["piece"], "start": pdf["start"], "n_chars": pdf["n"], "bin_id": (pdf["shard"].to_numpy() << 32) + b, "bin_offset": off})

    shard = F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards))
    placed = pieces.where("n > 0").withColumn("shard", shard).groupBy("shard").applyInPandas(job, schema)
    none = pieces.where("n <= 0").select("doc_id", "cluster", "piece", "start", F.col("n").alias("n_chars"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    return placed.unionByName(none)


def items_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The packer's items: length in characters; equal texts are one cluster."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("cluster"), F.length(text).alias("n_chars"))


def with_text(placed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Placements of items_of(docs) with each piece's text."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).cast("string").alias("cluster"), F.col(text).alias("text")).dropDuplicates(["doc_id", "cluster"])
    j = placed.alias("p").join(texts.alias("t"), F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.cluster") == F.col("t.cluster")), "left")
    return j.select("p.doc_id", "piece", "start", "n_chars", "bin_id", "bin_offset", F.substring(F.col("text"), F.col("start").cast("int") + 1, F.col("n_chars").cast("int")).alias("text"))
