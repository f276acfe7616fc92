"""Pair spreads, hedge ratios, z-scores, error correction; keyed by pair."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from termflow.functions.cols import div, gated, safe_log, seq, trailing
from termflow.operators.vol import realized_vol
from termflow.operators.xs import vol_targeted_sign

# The pair registry (name, first leg, second leg, hedge group).
PAIRS = [
    ("wti_brent", "WTI Crude", "Brent", "ratio"), ("gold_silver", "Gold", "Silver", "ratio"),
    ("platinum_palladium", "Platinum", "Palladium", "ratio"), ("wheat_kcwheat", "Wheat", "KC_Wheat", "ratio"),
    ("russell_sp500", "Russell2000", "SP500", "ratio"), ("nasdaq_sp500", "Nasdaq100", "SP500", "ratio"),
    ("corn_wheat", "Corn", "Wheat", "hedge"), ("rbob_heatingoil", "RBOB", "HeatingOil", "hedge"),
    ("livecattle_feedercattle", "LiveCattle", "FeederCattle", "hedge"), ("corn_soybeans", "Corn", "Soybeans", "hedge"),
    ("crack_spread", "WTI Crude", "RBOB+HeatingOil", "crack"),
]


def pair_registry(spark: SparkSession, hedge: bool | None = None) -> DataFrame:
    """(pair, leg_y, leg_x, grp) of the two-legged pairs; hedge picks those with an estimated ratio, or with a fixed one."""
    rows = [p for p in PAIRS if p[3] != "crack" and (hedge is None or (p[3] == "hedge") == hedge)]
    return spark.createDataFrame(rows, "pair string, leg_y string, leg_x string, grp string")
GALLONS_PER_BARREL = 42.0


def pair_prices(panel: DataFrame, registry: DataFrame, price: str = "close") -> DataFrame:
    """(pair, leg_y, leg_x, grp, date, py, px): two equi-joins, one row per pair and date."""
    y = panel.select(F.col("asset").alias("leg_y"), "date", F.col(price).alias("py"))
    x = panel.select(F.col("asset").alias("leg_x"), "date", F.col(price).alias("px"))
    return registry.join(y, "leg_y").join(x, ["leg_x", "date"])


def ols_beta(y: str, x: str, window: int = 252, key="pair", min_frac=0.7) -> Column:
    """Trailing covariance over variance; each side has its own gate."""
    w, g = trailing(window, key), max(1, int(window * min_frac))
    both = F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), F.col(x))
    return div(gated(F.covar_samp(y, x), both, w, g), gated(F.var_samp(x), x, w, g))


def log_spread(py: str, px: str, beta: Column) -> Column:
    return safe_log(py) - beta * safe_log(px)


def crack_level(panel: DataFrame, gas: str, oil: str, crude: str, price="close") -> DataFrame:
    """Three-two-one refining margin per date from one conditional aggregate."""
    def leg(a):
        return F.max(F.when(F.col("asset") == a, F.col(price)))
    return panel.groupBy("date").agg(
        ((2.0 * leg(gas) * GALLONS_PER_BARREL + leg(oil) * GALLONS_PER_BARREL) / 3.0 - leg(crude)).alias("spread"))


def spread_change(x: str, key="pair") -> Column:
    return F.col(x) - F.lag(x).over(seq(key))


def zscore(x: str, window: int = 63, key="pair", min_frac=0.7) -> Column:
    w, g = trailing(window, key), max(1, int(window * min_frac))
    return div(F.col(x) - gated(F.avg(x), x, w, g), gated(F.stddev_samp(x), x, w, g))


def continuous_size(z: str | Column, vol: str, target=1.0) -> Column:
    return div(-target * (F.col(z) if isinstance(z, str) else z), vol)


def threshold_band(df: DataFrame, z: str, entry=2.0, exit_=0.5, key="pair", out="state") -> DataFrame:
    """Short above +entry, long below -entry, flat inside exit; a missing z is missing but keeps the state.

    Every exit row forces flat whatever the state, so the state is the first entry since the last
    exit: two windows replace a sequential scan.
    """
    zc = F.col(z)
    x = df.withColumn("__e", F.when(zc > entry, -1.0).when(zc < -entry, 1.0))
    x = x.withColumn("__seg", F.sum(F.when(F.abs(zc) < exit_, 1).otherwise(0)).over(seq(key).rowsBetween(W.unboundedPreceding, 0)))
    w = seq((*((key,) if isinstance(key, str) else key), "__seg")).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn(out, F.when(zc.isNotNull(), F.coalesce(F.first("__e", ignorenulls=True).over(w), F.lit(0.0))))
    return x.drop("__e", "__seg")


def pair_signals(spreads: DataFrame, z_window=63, vol_window=63, target=1.0, entry=2.0, exit_=0.5, ppy=252) -> DataFrame:
    """Both entry rules for every pair: (pair, date, z, vol, continuous, threshold)."""
    x = spreads.withColumn("change", spread_change("spread")).withColumn("z", zscore("spread", z_window))
    x = x.withColumn("vol", realized_vol("change", vol_window, ppy, "pair"))
    x = threshold_band(x, "z", entry, exit_)
    return x.select("pair", "date", "spread", "change", "z", "vol", continuous_size("z", "vol", target).alias("continuous"),
                    vol_targeted_sign("state", "vol", target).alias("threshold"))


def policy_basis(price: DataFrame, rate: DataFrame) -> DataFrame:
    """100 - raw close - realized rate, the rate carried forward; keyed by asset."""
    j = price.join(rate, "date", "left").withColumn("rate", F.last("rate", True).over(seq().rowsBetween(W.unboundedPreceding, 0)))
    return j.withColumn("basis", 100 - F.col("close") - F.col("rate"))


# ---- error correction

MIN_FIT_ROWS = 30


def _ecm_rows(spreads: DataFrame, x: str, key) -> DataFrame:
    """Non-null rows with change, previous level and previous change; rn counts them."""
    s = spreads.where(F.col(x).isNotNull())
    w = seq(key)
    lvl = F.lag(x).over(w)
    dx = F.col(x) - lvl
    return s.withColumn("__l", lvl).withColumn("__d", dx).withColumn("__d1", F.lag(F.col("__d")).over(w)).withColumn(
        "rn", F.row_number().over(w))


def _ecm_lambda(agg) -> tuple[Column, Column]:
    """(lambda, n): two-regressor least squares with intercept from second moments."""
    ok = F.col("__d1").isNotNull()
    d, l, k = (F.when(ok, F.col(c)) for c in ("__d", "__l", "__d1"))
    cyl, cyk, clk = agg(F.covar_samp(d, l)), agg(F.covar_samp(d, k)), agg(F.covar_samp(l, k))
    vl, vk, n = agg(F.var_samp(l)), agg(F.var_samp(k)), agg(F.count(d))
    return F.when(n >= MIN_FIT_ROWS, div(cyl * vk - cyk * clk, vl * vk - clk * clk)), n


def _half_life(lam: Column) -> Column:
    return F.when(lam < 0, -math.log(2.0) / lam)


def rolling_half_life(spreads: DataFrame, x="spread", window=252, step=21, key="pair") -> DataFrame:
    """A fit at every step-th row over its trailing window, from windowed moments."""
    r = _ecm_rows(spreads, x, key)
    # The first two rows of a window have no lagged change inside it.
    w = seq(key).rowsBetween(-(window - 3), 0)
    lam, n = _ecm_lambda(lambda c: c.over(w))
    f = r.withColumn("lambda", lam).withColumn("n_obs", n).where(
        (F.col("rn") >= window) & ((F.col("rn") - window) % step == 0))
    return f.select(key, "date", "lambda", _half_life(F.col("lambda")).alias("half_life"), "n_obs")


def full_half_life(spreads: DataFrame, until: str, x="spread", key="pair") -> DataFrame:
    r = _ecm_rows(spreads.where(F.col("date") <= F.to_date(F.lit(until))), x, key)
    lam, n = _ecm_lambda(lambda c: c)
    g = r.groupBy(key).agg(lam.alias("lambda"), n.alias("n_obs"))
    return g.select(key, "lambda", _half_life(F.col("lambda")).alias("half_life"), "n_obs")


def median_half_life(rolling: DataFrame, until: str, key="pair") -> DataFrame:
    return rolling.where(F.col("date") <= F.to_date(F.lit(until))).groupBy(key).agg(
        F.percentile("half_life", F.lit(0.5)).alias("half_life"))


def half_life_window(h: str, multiplier=2.0, lo=10, hi=252, fallback: int | None = None) -> Column:
    w = F.least(F.greatest(F.bround(F.col(h) * multiplier, 0), F.lit(lo)), F.lit(hi)).cast("int")
    return F.when(F.col(h) > 0, w).otherwise(F.lit(fallback).cast("int"))
