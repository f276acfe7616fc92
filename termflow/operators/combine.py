"""Blends of several alphas held long by signal."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termflow.functions.cols import avg_rank, div, gated, prior


def blend(long: DataFrame, n_signals: int, weight: Column | None = None, x="signal", by=("asset", "date"), out="alpha") -> DataFrame:
    """Sum of weight * signal, NULL unless every signal is present; equal weights by default."""
    w = F.lit(1.0 / n_signals) if weight is None else weight
    v = w * F.col(x)
    return long.groupBy(*by).agg(F.when(F.count(v) == n_signals, F.sum(v)).alias(out))


def rank_blend(long: DataFrame, n_signals: int, x="signal", out="alpha") -> DataFrame:
    """Average of per-date percentile ranks."""
    r = long.withColumn("__r", avg_rank(x, "spec", "date") / F.count(x).over(W.partitionBy("spec", "date")))
    return blend(r, n_signals, x="__r", out=out)


def spearman_ic(long: DataFrame, x="signal", y="fwd", by=("spec", "date")) -> DataFrame:
    """Rank correlation over pairwise-complete rows, one aggregate per (spec, date)."""
    j = long.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = j.select(*by, avg_rank(x, *by).alias("__a"), avg_rank(y, *by).alias("__b"))
    sd = F.stddev_samp("__a") * F.stddev_samp("__b")
    return r.groupBy(*by).agg(F.when((F.count(F.lit(1)) >= 2) & (sd > 0), div(F.covar_samp("__a", "__b"), sd)).alias("ic"))


def _normalized(w: DataFrame, raw: str, n_signals: int) -> DataFrame:
    """Weights summing to one per date; equal weights where the sum is about zero."""
    d = W.partitionBy("date")
    tot = F.coalesce(F.sum(raw).over(d), F.lit(0.0))
    return w.withColumn("weight", F.when(tot < 1e-8, F.lit(1.0 / n_signals)).otherwise(F.col(raw) / tot))


def ic_weights(ic: DataFrame, calendar: DataFrame, n_signals: int, lookback=252, min_obs=20) -> DataFrame:
    """Trailing mean IC of earlier rows, floored at zero, normalized. calendar: (spec, date), dense."""
    x = calendar.join(ic, ["spec", "date"], "left")
    m = gated(F.avg("ic"), "ic", prior(lookback, "spec"), min_obs)
    x = x.withColumn("__w", F.when(m.isNotNull(), F.greatest(m, F.lit(0.0))))
    return _normalized(x, "__w", n_signals).select("spec", "date", "weight")


def inverse_vol_weights(pnl: DataFrame, n_signals: int, lookback=252, min_obs=20, r="pnl") -> DataFrame:
    sd = gated(F.stddev_samp(r), r, prior(lookback, "spec"), min_obs)
    x = pnl.withColumn("__w", F.when(sd > 0, 1.0 / sd))
    return _normalized(x, "__w", n_signals).select("spec", "date", "weight")


def weighted_blend(long: DataFrame, weights: DataFrame, n_signals: int, x="signal", out="alpha") -> DataFrame:
    return blend(long.join(weights, ["spec", "date"], "left"), n_signals, F.col("weight"), x, out=out)


def confirm(primary: str, vote: str, agree=1.0, disagree=0.0) -> Column:
    same = F.coalesce(F.signum(primary) == F.signum(vote), F.lit(False))
    return F.col(primary) * F.when(same, agree).otherwise(disagree)
