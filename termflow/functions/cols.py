"""Column helpers shared by every operator: NULL-safe arithmetic, gates, tie-averaged ranks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is zero (ANSI-safe)."""
    return F.try_divide(col(a), col(b))


def safe_log(x: str | Column) -> Column:
    x = col(x)
    return F.when(x > 0, F.ln(x))


def keys(key: str | tuple[str, ...]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def seq(key="asset", order="date") -> WindowSpec:
    """Per-key ordered window without a frame (lag / lead / row_number)."""
    return W.partitionBy(*keys(key)).orderBy(order)


def trailing(n: int, key="asset", order="date") -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return seq(key, order).rowsBetween(-(n - 1), 0)


def prior(n: int, key="asset", order="date") -> WindowSpec:
    """The n rows before the current one (today excluded)."""
    return seq(key, order).rowsBetween(-n, -1)


def running(key="asset", order="date") -> WindowSpec:
    return seq(key, order).rowsBetween(W.unboundedPreceding, 0)


def gated(agg: Column, count_of: str | Column, w: WindowSpec, min_obs: int) -> Column:
    """agg over w, NULL while w holds fewer than min_obs non-null values."""
    return F.when(F.count(col(count_of)).over(w) >= min_obs, agg.over(w))


def ffill(x: str | Column, key="asset", order="date", limit: int | None = None) -> Column:
    """Last non-null value; limit counts rows."""
    w = seq(key, order).rowsBetween(W.unboundedPreceding if limit is None else -limit, 0)
    return F.last(col(x), ignorenulls=True).over(w)


def avg_rank(x: str, *part: str) -> Column:
    """Rank among non-null values with ties averaged; one sort serves both bounds."""
    w = W.partitionBy(*part).orderBy(F.col(x).asc_nulls_last())
    upper = F.count(F.col(x)).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    return F.when(F.col(x).isNotNull(), (F.rank().over(w) + upper) / F.lit(2.0))


def null_nan(x: str | Column) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def r(x: str | Column, d: int = 6) -> Column:
    return F.round(col(x), d)


def rounded(df: DataFrame, d: int = 6, **per: int) -> DataFrame:
    """Round every double column for reporting."""
    return df.select(*[
        F.round(F.col(c), per.get(c, d)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes
    ])
