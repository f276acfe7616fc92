"""Exact top-k inner-product search over a pivot-distance index.

Vectors become integers, floor(scale x); one more coordinate brings all to the largest norm, so the largest inner product is the nearest
neighbour. Each vector is keyed by its nearest pivot and its distance to it; sorted distances are cut into annuli. A
query first reads the annuli nearest to it, which bounds its k-th distance, then every annulus that the triangle
inequality can't rule out, in order of the bound, while its k-th distance shrinks. The result is exact: recall is 1.

Cases: a vector that is null or holds null, NaN or infinity takes no part; ties go to the smaller id; a shorter vector is filled with
zeros; equal vectors are all candidates; a query never returns its own id; fewer than k candidates give all; empty
tables give an empty result; other columns take no part.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termflow.session import materialize

SCALE = 1024
TOP = 10
#: Vectors that pivots are fitted on; most pivots, most annuli of one pivot; vectors a cell aims at.
SAMPLE, MAX_PIVOTS, MAX_ANNULI, CELL_ROWS = 4096, 64, 64, 1024
#: Vectors in one stored block, queries handled together, blocks searched in one task's group.
BLOCK_ROWS, QUERY_ROWS, GROUP_BLOCKS = 2048, 512, 32
#: Float64 sums of integers are exact below this.
EXACT = float(1 << 53)


def valid(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    ok = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return ok.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def fit_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; x is sorted by id hash, so the fit repeats."""
    p = x[np.linspace(0, len(x) - 1, count).astype(int)].astype(np.float64)
    for _ in range(6):
        near = np.argmin((p ** 2).sum(1)[None] - 2 * x @ p.T, axis=1)
        for j in range(count):
            if (near == j).any():
                p[j] = x[near == j].mean(axis=0)
    return p


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """One more coordinate, so that all rows have the same norm."""
    rest = np.sqrt(np.maximum(0.0, largest - (x ** 2).sum(axis=1)))
    return np.column_stack([x, rest])


def bounds(q: np.ndarray, cells: pd.DataFrame, pivots: np.ndarray) -> np.ndarray:
    """Least distance from each query to any vector of each cell."""
    d = np.sqrt(np.maximum(0, (q ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None] - 2 * q @ pivots.T))
    own = d[:, cells["pivot"].to_numpy()]
    return np.maximum(0.0, np.maximum(own - cells["far"].to_numpy()[None], cells["near"].to_numpy()[None] - own))


def merge_top(ids: np.ndarray, scores: np.ndarray, new_ids: np.ndarray, new_scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query: largest score, then smallest id."""
    i, s = np.concatenate([ids, new_ids]), np.concatenate([scores, new_scores])
    if len(i) > k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        keep = s >= cut
        i, s = i[keep], s[keep]
    order = np.lexsort((i, -s))[:k]
    return i[order], s[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products of each row of `queries` among `vectors`."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score long"
    data = materialize(valid(vectors, id_col, column), "pivot-vectors")
    n, width, largest = data.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    if not n or not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = materialize(valid(queries, id_col, column), "pivot-queries")
    n_asked, q_largest = asked.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    exact = max(largest, q_largest) < EXACT

    def matrix(rows: pd.Series, dtype: type = np.int64) -> np.ndarray:
        m = np.zeros((len(rows), width), dtype)
        for i, r in enumerate(rows):
            m[i, :min(len(r), width)] = r[:width]
        return m

    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    count = int(max(1, min(MAX_PIVOTS, n // (2 * CELL_ROWS), len(sample))))
    pivots = fit_pivots(lift(matrix(sample["v"], np.float64), largest), count)
    annuli = int(max(1, min(MAX_ANNULI, n // (count * CELL_ROWS))))
    shared = spark.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for b in batches:
            v = matrix(b["v"])
            x = lift(v.astype(np.float64), largest)
            d = np.sqrt(np.maximum(0, (x ** 2).sum(1)[:, None] + (p ** 2).sum(1)[None] - 2 * x @ p.T))
            near = np.argmin(d, axis=1)
            yield pd.DataFrame({"vec_id": b["vec_id"], "pivot": near, "dist": d[np.arange(len(b)), near], "v": [r.tobytes() for r in v.astype(np.int64)]})

    keyed = materialize(data.mapInPandas(key, "vec_id long, pivot int, dist double, v binary"), "pivot-keyed")
    cuts = keyed.groupBy("pivot").agg(F.expr(f"percentile_approx(dist, array({','.join(str((i + 1) / annuli) for i in range(annuli))}), 10000)").alias("cuts"))
    keyed = keyed.join(F.broadcast(cuts), "pivot")  # a row per pivot
    ring = F.least(F.size(F.filter("cuts", lambda c: c < F.col("dist"))), F.lit(annuli - 1))
    keyed = keyed.withColumn("cell", (F.col("pivot") * annuli + ring).cast("int")).drop("cuts")
    cells = keyed.groupBy("cell", "pivot").agg(F.min("dist").alias("near"), F.max("dist").alias("far"), F.count("*").alias("rows")).orderBy("cell").toPandas()
    slack = 1e-6 * (1.0 + np.sqrt(max(largest, q_largest)))
    cells["near"] -= slack
    cells["far"] += slack
    known = spark.sparkContext.broadcast(cells)
    parts = spark.createDataFrame(pd.DataFrame({"cell": cells["cell"].astype("int32"), "parts": -(-cells["rows"] // BLOCK_ROWS)}), "cell int, parts long")

    def block(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [keys[0]], "part": [keys[1]], "ids": [pdf["vec_id"].to_numpy().astype(np.int64).tobytes()], "vecs": [b"".join(pdf["v"])]})

    blocks = keyed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    blocks = materialize(blocks.groupBy("cell", "part").applyInPandas(block, "cell int, part long, ids binary, vecs binary"), "pivot-blocks")

    n_blocks = max(1, -(-n_asked // QUERY_ROWS))
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("qblock"))

    def query_matrix(v: pd.Series) -> np.ndarray:
        return matrix(v, np.float64)

    def reach(q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: stored blocks. right: queries with the distance within which their k best lie."""
        c, p = known.value.set_index("cell"), shared.value
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q = query_matrix(right["v"])
        norm = (q ** 2).sum(1)
        ids = right["query_id"].to_numpy()
        limit = right["limit"].to_numpy(dtype=np.float64).copy()
        low = bounds(reach(q), c.loc[left["cell"]].reset_index(), p)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for j in np.argsort(low.min(axis=0), kind="stable"):
            want = np.flatnonzero(low[:, j] <= limit)
            if not len(want):
                continue
            v_ids = np.frombuffer(left["ids"].iloc[j], np.int64)
            v = np.frombuffer(left["vecs"].iloc[j], np.int64).reshape(len(v_ids), width)
            s = (q[want] @ v.T.astype(np.float64)).astype(np.int64) if exact else q[want].astype(np.int64) @ v.T
            for r, i in enumerate(want):
                other = v_ids != ids[i]
                best[i] = merge_top(*best[i], v_ids[other], s[r][other], k)
                if len(best[i][0]) == k:
                    limit[i] = min(limit[i], np.sqrt(max(0.0, norm[i] + largest - 2.0 * best[i][1][-1])) + slack)
        return pd.DataFrame({"query_id": np.repeat(ids, [len(b[0]) for b in best]), "vec_id": np.concatenate([b[0] for b in best]), "score": np.concatenate([b[1] for b in best])})

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nearest cells of each query that hold more than k vectors together."""
        for b in batches:
            low = bounds(reach(query_matrix(b["v"])), known.value, shared.value)
            rows, who, cell = known.value["rows"].to_numpy(), [], []
            for i in range(len(b)):
                order = np.argsort(low[i], kind="stable")
                take = order[:int(np.searchsorted(np.cumsum(rows[order]), k + 1)) + 1]
                who += [i] * len(take)
                cell += known.value["cell"].to_numpy()[take].tolist()
            yield b.iloc[who].assign(cell=np.array(cell, np.int32), limit=np.inf)

    first = asked.mapInPandas(seeds, "query_id long, v array<long>, qblock long, cell int, limit double")
    first = materialize(first, "pivot-seeds")
    wanted = first.select(F.col("cell").alias("to_cell"), F.col("qblock").alias("for_qblock")).distinct()
    near = blocks.join(wanted, F.col("cell") == F.col("to_cell")).groupBy("to_cell", "for_qblock").cogroup(first.groupBy("cell", "qblock")).applyInPandas(search, out)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = materialize(near.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "pivot-near")
    kth = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))

    groups = max(1, -(-blocks.count() // GROUP_BLOCKS))

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells that a query's bound doesn't rule out, with the bound."""
        for b in batches:
            q = query_matrix(b["v"])
            kth_ = b["kth"].to_numpy(dtype=np.float64)
            limit = np.where(np.isnan(kth_), np.inf, np.sqrt(np.maximum(0, (q ** 2).sum(1) + largest - 2 * np.nan_to_num(kth_))) + slack)
            hit = bounds(reach(q), known.value, shared.value) <= limit[:, None]
            yield b.drop(columns="kth").assign(limit=limit, cells=[known.value["cell"].to_numpy()[h].astype(np.int32) for h in hit])

    ready = asked.join(kth, "query_id", "left").mapInPandas(needed, "query_id long, v array<long>, qblock long, limit double, cells array<int>")
    ready = materialize(ready, "pivot-ready")
    pairs = ready.select(F.col("qblock").alias("for_qblock"), F.explode("cells").alias("to_cell")).distinct()
    grouped = blocks.withColumn("in_grp", F.pmod(F.xxhash64("cell", "part"), F.lit(groups))).join(pairs, F.col("cell") == F.col("to_cell"))
    spread = ready.drop("cells").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("grp", F.col("grp").cast("long"))
    found = grouped.groupBy("for_qblock", "in_grp").cogroup(spread.groupBy("qblock", "grp")).applyInPandas(search, out)
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
