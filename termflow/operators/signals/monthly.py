"""Month-end building blocks: exact month lags on an integer month index."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termflow.functions.cols import gated, keys
from termflow.operators.panel import period_last, spread_to_panel


def month_ends(panel: DataFrame, value: str, key="asset") -> DataFrame:
    return period_last(panel, value, "monthly", key)


def months(a: int, b: int, key="asset"):
    """Window over month indices idx+a .. idx+b."""
    return W.partitionBy(*keys(key)).orderBy("idx").rangeBetween(a, b)


def month_lag(x: str, k: int, key="asset") -> Column:
    return F.max(x).over(months(-k, -k, key))


def month_mean(x: str, a: int, b: int, gate: int, key="asset") -> Column:
    return gated(F.avg(x), x, months(a, b, key), gate)


def to_panel(panel: DataFrame, per: DataFrame, value: str, key="asset", limit: int | None = None, align="label", out=None) -> DataFrame:
    return spread_to_panel(panel, per, value, key, align, limit, out)
