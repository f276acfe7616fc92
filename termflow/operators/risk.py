"""Stream correlation, sleeve covariance, tail risk and risk parity; keyed by stream, pair or set."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termflow.functions.cols import div, keys, trailing


def combine_static(streams: DataFrame, weights: dict[str, float], x: str = "pnl") -> DataFrame:
    """Weighted sum of return streams over the union of their dates; absent dates add nothing."""
    w: Column = F.lit(0.0)
    for s, v in weights.items():
        w = F.when(F.col("stream") == s, v).otherwise(w)
    return streams.groupBy("date").agg(F.sum(w * F.col(x)).alias(x))


def stream_pairs(streams: DataFrame, x: str = "pnl") -> DataFrame:
    """(a, b, date, xa, xb): inner-aligned non-null pairs a < b, met by equality on date.

    Streams are strategies, a handful by construction.
    """
    l = streams.where(F.col(x).isNotNull()).select("date", F.col("stream").alias("a"), F.col(x).alias("xa"))
    r = streams.where(F.col(x).isNotNull()).select("date", F.col("stream").alias("b"), F.col(x).alias("xb"))
    return l.join(r, "date").where("a < b")


def rolling_correlation(pairs: DataFrame, window: int, out="corr") -> DataFrame:
    w = trailing(window, ("a", "b"))
    sd = F.stddev_samp("xa").over(w) * F.stddev_samp("xb").over(w)
    return pairs.withColumn(out, F.when((F.count("xa").over(w) >= window) & (sd > 0), F.covar_samp("xa", "xb").over(w) / sd))


def ewma_correlation(pairs: DataFrame, halflife: float, out="corr") -> DataFrame:
    """Exponentially weighted raw-product correlation, one fold per pair of streams."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        e = [s.ewm(halflife=halflife, adjust=False).mean() for s in (pdf.xa * pdf.xb, pdf.xa ** 2, pdf.xb ** 2)]
        pdf[out] = (e[0] / np.sqrt(e[1] * e[2])).where(e[1] * e[2] > 0)
        return pdf[["a", "b", "date", out]].replace({np.nan: None})
    return pairs.groupBy("a", "b").applyInPandas(fold, f"a string, b string, date date, {out} double")


def correlation_summary(corr: DataFrame, by=("a", "b"), x="corr") -> DataFrame:
    return corr.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                                 F.max(x).alias("max"), F.avg((F.col(x) < 0).cast("double")).alias("pct_negative"))


def stress_means(corr: DataFrame, windows: DataFrame, x="corr") -> DataFrame:
    """Mean correlation inside each stress window; windows(window, start, end) is a short dimension.

    The window list is packed to one array and filtered per row, so no range join is planned.
    """
    w = windows.agg(F.collect_list(F.struct("window", "start", "end")).alias("w"))
    j = corr.select("*", F.explode(w.scalar()).alias("w")).where(F.col("date").between(F.col("w.start"), F.col("w.end")))
    return j.groupBy("a", "b", F.col("w.window").alias("window")).agg(F.avg(x).alias("mean"), F.count(x).alias("n"))


def complete_rows(streams: DataFrame, n_streams: int, x="pnl", by=()) -> DataFrame:
    """Dates on which every stream has a value."""
    ok = streams.groupBy(*by, "date").agg(F.count(x).alias("__n")).where(F.col("__n") == n_streams).drop("__n")
    return streams.join(ok, [*by, "date"], "left_semi")


def sleeve_covariance(streams: DataFrame, n_streams: int, window: int = 63, x="pnl") -> DataFrame:
    """Sample covariance of the last `window` complete rows, as a pair table including the diagonal."""
    c = complete_rows(streams, n_streams, x)
    c = c.withColumn("__k", F.row_number().over(W.partitionBy("stream").orderBy(F.desc("date")))).where(F.col("__k") <= window)
    b = c.select("date", F.col("stream").alias("j"), F.col(x).alias("__y"))
    return c.select("date", F.col("stream").alias("i"), F.col(x).alias("__x")).join(b, "date").groupBy("i", "j").agg(F.covar_samp("__x", "__y").alias("cov"))


def sleeve_ewma_covariance(streams: DataFrame, n_streams: int, halflife: float = 26, x="pnl") -> DataFrame:
    """Exponentially weighted covariance at the last date, bias-corrected, from weighted sums."""
    c = complete_rows(streams, n_streams, x)
    age = F.row_number().over(W.partitionBy("stream").orderBy(F.desc("date"))) - 1
    decay = math.exp(-math.log(2.0) / halflife)
    c = c.withColumn("__w", F.pow(F.lit(decay), age))
    b = c.select("date", F.col("stream").alias("j"), F.col(x).alias("__y"))
    g = c.select("date", F.col("stream").alias("i"), F.col(x).alias("__x"), "__w").join(b, "date").groupBy("i", "j").agg(
        F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__w")).alias("w2"), F.sum(F.col("__w") * F.col("__x")).alias("sx"),
        F.sum(F.col("__w") * F.col("__y")).alias("sy"), F.sum(F.col("__w") * F.col("__x") * F.col("__y")).alias("sxy"))
    biased = F.col("sxy") / F.col("w") - F.col("sx") * F.col("sy") / (F.col("w") * F.col("w"))
    return g.select("i", "j", (biased * F.col("w") * F.col("w") / (F.col("w") * F.col("w") - F.col("w2"))).alias("cov"))


# ---- tail risk

def historical_tail(df: DataFrame, by: list[str], x="pnl", level: float = 0.95) -> DataFrame:
    """VaR and expected shortfall per stream; the quantile joins back to pick the tail."""
    v = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.percentile(x, F.lit(1 - level)).alias("var"))
    t = df.where(F.col(x).isNotNull()).join(v, by)
    return t.groupBy(*by, "var").agg(F.avg(F.when(F.col(x) <= F.col("var"), F.col(x))).alias("es"))


class RankSums:
    """Counts and sums of values by rank (a binary indexed tree): insertion, the k-th smallest and the sum below it in O(log n)."""

    def __init__(self, n: int):
        self.n, self.top = n, 1 << max(0, n.bit_length() - 1)
        self.count, self.total = [0] * (n + 1), [0.0] * (n + 1)

    def add(self, rank: int, value: float) -> None:
        i = rank + 1
        while i <= self.n:
            self.count[i] += 1
            self.total[i] += value
            i += i & -i

    def smallest(self, k: int) -> int:
        """Rank of the k-th smallest value, counted from 0."""
        at, step = 0, self.top
        while step:
            if at + step <= self.n and self.count[at + step] <= k:
                at += step
                k -= self.count[at]
            step >>= 1
        return at

    def below(self, rank: int) -> tuple[int, float]:
        """Count and sum of the values of lower rank."""
        n, total = 0, 0.0
        while rank:
            n, total = n + self.count[rank], total + self.total[rank]
            rank &= rank - 1
        return n, total


def expanding_tail(df: DataFrame, key, x="pnl", level: float = 0.95, min_obs: int = 24) -> DataFrame:
    """(key, date, var, es): interpolated quantile of all returns so far and the mean of those at or below it.

    One keyed fold per stream with an order-statistic structure, O(n log n); no row carries its history. Rows without a
    return keep the last figures.
    """
    k = keys(key)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        v = pdf["__x"].to_numpy(dtype=float)
        known = ~np.isnan(v)
        rank = np.zeros(len(v), int)
        rank[known] = np.argsort(np.argsort(v[known], kind="stable"), kind="stable")
        ordered = np.sort(v[known])
        tree, seen, var, es = RankSums(len(ordered)), 0, [], []
        for value, ok, r in zip(v.tolist(), known.tolist(), rank.tolist()):
            if ok:
                tree.add(r, value)
                seen += 1
            if seen < max(min_obs, 1):
                var.append(None)
                es.append(None)
                continue
            at = (seen - 1) * (1 - level)
            low = int(at)
            q = float(ordered[tree.smallest(low)])
            if low + 1 < seen:
                q += (at - low) * (float(ordered[tree.smallest(low + 1)]) - q)
            n, total = tree.below(int(np.searchsorted(ordered, q, "right")))
            var.append(q)
            es.append(total / n)
        return pdf[[*k, "date"]].assign(var=var, es=es)

    types = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in k)
    return df.select(*k, "date", F.col(x).cast("double").alias("__x")).groupBy(*k).applyInPandas(fold, f"{types}, date date, var double, es double")


# ---- risk parity

def risk_contributions(weights: DataFrame, cov: DataFrame, by=("set_id",)) -> DataFrame:
    """w_i (Cov w)_i / w'Cov w from the pair table; weights(set_id, i, w), cov(set_id, i, j, cov)."""
    wj = weights.select(*by, F.col("i").alias("j"), F.col("w").alias("wj"))
    m = cov.join(wj, [*by, "j"]).groupBy(*by, "i").agg(F.sum(F.col("cov") * F.col("wj")).alias("__mw"))
    r = weights.join(m, [*by, "i"]).withColumn("rc", F.col("w") * F.col("__mw"))
    return r.withColumn("share", div("rc", F.sum("rc").over(W.partitionBy(*by)))).select(*by, "i", "w", "rc", "share")


def risk_parity(cov: DataFrame, budgets: DataFrame | None = None, by=("set_id",)) -> DataFrame:
    """Risk-budget weights for every sleeve set, one small convex solve per set.

    Minimizes w'Cw/2 - sum b ln w by cyclic coordinate steps on a scale-normalized matrix.
    """
    key = list(by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="i", columns="j", values="cov")
        c = m.to_numpy()
        c = c / np.mean(np.diag(c))
        b = pdf.groupby("i")["b"].first().reindex(m.index).to_numpy()
        b = b / b.sum()
        w = np.sqrt(b / np.diag(c))
        converged = False
        for _ in range(2000):
            old = w.copy()
            for k in range(len(w)):
                rest = c[k] @ w - c[k, k] * w[k]
                w[k] = (-rest + math.sqrt(rest * rest + 4 * c[k, k] * b[k])) / (2 * c[k, k])
            if np.abs(w - old).max() < 1e-13 * w.max():
                converged = True
                break
        out = pdf[key].iloc[[0] * len(w)].reset_index(drop=True)
        return out.assign(i=m.index.to_numpy(), w=w / w.sum(), converged=converged)

    x = cov.join(budgets, [*key, "i"], "left") if budgets is not None else cov.withColumn("b", F.lit(1.0))
    x = x.withColumn("b", F.coalesce("b", F.lit(1.0))).select(*key, "i", "j", "cov", "b")
    types = ", ".join(f"{c} {t}" for c, t in x.dtypes if c in key)
    return x.groupBy(*key).applyInPandas(solve, f"{types}, i string, w double, converged boolean")
