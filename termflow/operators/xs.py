"""Cross-sectional and transform operators: windows by date or (date, sector)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termflow.functions.cols import avg_rank, col, div, gated, prior, running


def binary(x: str) -> Column:
    return F.signum(x)


def continuous(x: str, vol: str) -> Column:
    return div(x, vol)


def rank_centered(x: str, *part: str) -> Column:
    """Percentile rank among non-null peers, minus one half."""
    part = part or ("date",)
    return avg_rank(x, *part) / F.count(x).over(W.partitionBy(*part)) - 0.5


def vol_targeted_sign(x: str | Column, vol: str, target: float = 1.0) -> Column:
    return div(target * F.signum(col(x)), vol)


def deadband(df: DataFrame, x: str, vol: str, target: float = 1.0, q: float = 0.5, window: int = 252,
             min_periods: int = 60, key="asset", out: str = "signal") -> DataFrame:
    """Flat while |x| is below its own earlier trailing quantile, or before one exists."""
    w = prior(window, key)
    thr = gated(F.percentile(F.abs(x), F.lit(q)), x, w, min_periods)
    on = F.coalesce(F.abs(x) >= thr, F.lit(False))
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.when(on, vol_targeted_sign(x, vol, target)).otherwise(0.0)))


def sector_rank(x: str, min_group: int = 2, part=("date", "sector")) -> Column:
    """Average-tie rank minus the group's mean rank."""
    n = F.count(x).over(W.partitionBy(*part))
    return F.when(n >= min_group, avg_rank(x, *part) - (n + 1) / 2.0)


def demean(x: str, min_group: int = 2, part=("date", "sector")) -> Column:
    w = W.partitionBy(*part)
    return F.when(F.count(x).over(w) >= min_group, F.col(x) - F.avg(x).over(w))


def sector_average(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy("date", "sector").agg(F.avg(x).alias(x))


def sector_expanding_mean(df: DataFrame, x: str, out: str) -> DataFrame:
    """Sector average per date, averaged from the start to that date, given to every member."""
    s = sector_average(df, x).withColumn(out, F.avg(x).over(running("sector"))).drop(x)
    return df.join(s, ["date", "sector"], "left")


def size_multiplier(series: DataFrame, x: str = "close", lookback: int = 252, min_periods: int = 60) -> DataFrame:
    """Level over its own earlier trailing mean. `series` has one row per date."""
    w = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-lookback, -1)
    return series.withColumn("mult", div(x, gated(F.avg(x), x, w, min_periods)))


def apply_multiplier(pos: DataFrame, mult: DataFrame, x: str = "pos") -> DataFrame:
    return pos.join(mult.select("date", "mult"), "date", "left").withColumn(x, F.col(x) * F.col("mult"))


def train_scaled(df: DataFrame, x: str, train_end: str) -> DataFrame:
    """x over its pooled training-period standard deviation (1.0 when unusable)."""
    sd = df.where(F.col("date") <= F.to_date(F.lit(train_end))).agg(F.stddev_samp(x).alias("sd")).scalar()
    return df.withColumn("scaled", F.col(x) / F.coalesce(F.when(sd > 0, sd), F.lit(1.0)))
