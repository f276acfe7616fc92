"""Volatility estimators and forecast scoring (windows by asset, no Python)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termflow.functions.cols import col, div, gated, safe_log, seq, trailing


def realized_vol(ret: str, window: int = 63, ppy: int = 252, key="asset", min_frac: float = 0.5) -> Column:
    w = trailing(window, key)
    return gated(F.stddev_samp(ret), ret, w, max(1, int(window * min_frac))) * math.sqrt(ppy)


def yang_zhang(df: DataFrame, window: int = 63, annualize: bool = True, roll: str | None = None,
               min_frac: float = 0.7, overnight_min_frac: float = 0.3, key="asset",
               out: str = "vol", ppy: int = 252) -> DataFrame:
    """Overnight variance + k * open-close variance + (1-k) * Rogers-Satchell mean.

    Roll days contribute no overnight return. The three legs gate separately.
    """
    o, h, l, c = (safe_log(x) for x in ("open", "high", "low", "close"))
    ro = o - F.lag(c).over(seq(key))
    if roll:
        ro = F.when(~F.coalesce(F.col(roll), F.lit(False)), ro)
    x = (df.withColumn("__ro", ro).withColumn("__rc", c - o)
         .withColumn("__rs", (h - c) * (h - o) + (l - c) * (l - o)))
    w = trailing(window, key)
    g, go = max(1, int(window * min_frac)), max(1, int(window * overnight_min_frac))
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    var = (gated(F.var_samp("__ro"), "__ro", w, go) + k * gated(F.var_samp("__rc"), "__rc", w, g)
           + (1 - k) * gated(F.avg("__rs"), "__rs", w, g))
    v = F.sqrt(F.greatest(var, F.lit(0.0))) * (math.sqrt(ppy) if annualize else 1.0)
    return x.withColumn(out, F.when(var.isNotNull(), v)).drop("__ro", "__rc", "__rs")


def yang_zhang_strict(df: DataFrame, horizons=(21, 63, 126, 252), key="asset") -> DataFrame:
    """Full-window gates, per-period units; every horizon shares one sort."""
    for h in horizons:
        df = yang_zhang(df, h, False, None, 1.0, 1.0, key, f"vol_{h}")
    return df


def latest_snapshot(df: DataFrame, cols: list[str], ppy: int = 252) -> DataFrame:
    """Rows at each asset's last panel date, annualized."""
    last = df.agg(F.max("date").alias("d")).scalar()
    return df.where(F.col("date") == last).select(
        "asset", "date", *[(F.col(c) * math.sqrt(ppy)).alias(c) for c in cols])


def forward_variance(ret: str, horizon: int, ppy: int = 252, key="asset") -> Column:
    """Realized variance over the next `horizon` rows, all of them present."""
    w = seq(key).rowsBetween(1, horizon)
    return gated(F.sum(F.col(ret) * F.col(ret)), ret, w, horizon) * (ppy / horizon)


def qlike(forecast_var: str | Column, realized_var: str | Column) -> Column:
    x = F.when(col(forecast_var) > 0, div(realized_var, forecast_var))
    return F.when(x > 0, x - F.ln(x) - 1)


def mse_vol(forecast_var: str | Column, realized_var: str | Column) -> Column:
    e = F.sqrt(col(forecast_var)) - F.sqrt(col(realized_var))
    return e * e


def mean_loss(df: DataFrame, loss: str, by: list[str], min_obs: int = 20) -> DataFrame:
    return df.groupBy(*by).agg(F.when(F.count(loss) >= min_obs, F.avg(loss)).alias("loss"),
                               F.count(loss).alias("n"))


def unpivot_estimators(df: DataFrame, ests: list[str], ids: list[str]) -> DataFrame:
    return df.unpivot(ids, ests, "estimator", "forecast")


def per_asset_winner(losses: DataFrame, n_estimators: int, by=("asset",)) -> DataFrame:
    """Lowest-loss estimator and its margin, only where every estimator has a loss."""
    return (losses.groupBy(*by).agg(
        F.min_by("estimator", F.struct("loss", "estimator")).alias("winner"),
        (F.max("loss") - F.min("loss")).alias("margin"), F.count("loss").alias("k"))
        .where(F.col("k") == n_estimators).drop("k"))


def win_rates(winners: DataFrame, by=()) -> DataFrame:
    g = winners.groupBy(*by, "winner").agg(F.count(F.lit(1)).alias("wins"))
    return g.withColumn("win_rate", F.col("wins") / F.sum("wins").over(W.partitionBy(*by)))
