"""Momentum, breakout and crossover families."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from termflow.functions.cols import col, div, gated, prior, seq, trailing
from termflow.operators.xs import vol_targeted_sign

ROWS_PER_MONTH = 21


def raw_momentum_rows(x: str | Column, lookback: int, skip: int = 0, key="asset") -> Column:
    w = seq(key)
    return div(F.lag(col(x), skip).over(w), F.lag(col(x), skip + lookback).over(w)) - 1


def raw_momentum(x: str, lookback_months: int, skip_months: int = 0, key="asset", per_month: int = ROWS_PER_MONTH) -> Column:
    return raw_momentum_rows(x, lookback_months * per_month, skip_months * per_month, key)


def tsmom(df: DataFrame, close="close", vol="vol", lookback_months: int = 12, target: float = 0.40,
          per_month: int = ROWS_PER_MONTH, out="signal") -> DataFrame:
    return df.withColumn(out, vol_targeted_sign(raw_momentum(close, lookback_months, per_month=per_month), vol, target))


def momentum_grid(df: DataFrame, lookbacks: list[int], close="close", vol="vol", target=0.40,
                  per_month: int = ROWS_PER_MONTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long by lookback, with the `keep` columns; every lag comes from one sorted window pass."""
    cols = [f"k{k}" for k in lookbacks]
    wide = df.select("asset", "date", *keep, *[
        vol_targeted_sign(raw_momentum(close, k, per_month=per_month), vol, target).alias(c)
        for k, c in zip(lookbacks, cols)])
    return wide.unpivot(["asset", "date", *keep], cols, "spec", "signal").withColumn(
        "lookback", F.substring("spec", 2, 9).cast("int")).drop("spec")


def donchian_channels(df: DataFrame, windows: list[int], close="close", key="asset") -> DataFrame:
    """hi_n / lo_n over the n rows before today, all n present."""
    for n in windows:
        w = prior(n, key)
        df = df.withColumn(f"hi_{n}", gated(F.max(close), close, w, n)).withColumn(
            f"lo_{n}", gated(F.min(close), close, w, n))
    return df


def sma(x: str, n: int, key="asset", min_frac: float = 0.7) -> Column:
    return gated(F.avg(x), x, trailing(n, key), max(1, int(n * min_frac)))


def crossover_raw(x: str, fast: int, slow: int, key="asset") -> Column:
    return sma(x, fast, key) - sma(x, slow, key)


def crossover_pairs(df: DataFrame, pairs: list[tuple[int, int]], close="close", vol="vol", target=0.40) -> DataFrame:
    names = [f"{a}/{b}" for a, b in pairs]
    wide = df.select("asset", "date", *[
        vol_targeted_sign(crossover_raw(close, a, b), vol, target).alias(n) for (a, b), n in zip(pairs, names)])
    return wide.unpivot(["asset", "date"], [F.col(f"`{n}`") for n in names], "pair", "signal")
