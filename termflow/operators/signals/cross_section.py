"""Reversal, carry, cross-sectional momentum, value and seasonality families."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from termflow.functions.cols import div, ffill, gated, safe_log, seq
from termflow.operators import xs
from termflow.operators.backtest import holding_positions
from termflow.operators.signals.monthly import month_ends, month_lag, month_mean, months, to_panel

# Month-end value look-back, bond maturity and currency country maps.
VALUE_END_MONTHS, VALUE_WINDOW_MONTHS, VALUE_LAG_MONTHS, FX_FILL_ROWS = 54, 12, 60, 35
BOND_MATURITY = {"US_2Y": "2Y", "US_5Y": "5Y", "US_10Y": "10Y", "US_30Y": "30Y", "UltraBond": "30Y"}
FX_COUNTRY = {"EURUSD": "EUR", "JPYUSD": "JPY", "GBPUSD": "GBP", "AUDUSD": "AUD", "CADUSD": "CAD",
              "SwissFranc": "CHF", "MexicanPeso": "MXN"}
# Seasonal demand windows (first month, last month).
SEASONAL_WINDOWS = {"Natural Gas": (11, 3), "HeatingOil": (10, 2), "RBOB": (4, 9), "Corn": (6, 8),
                    "Soybeans": (6, 8), "Wheat": (3, 6), "KC_Wheat": (3, 6)}
# First day-of-year of each month in a non-leap year, and month lengths.
MONTH_START = (1, 32, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


# ---- reversal

def lag_return(close: str, lag: int, key="asset") -> Column:
    return div(close, F.lag(close, lag).over(seq(key))) - 1


def standardized_return(close: str, vol: str, lag: int, key="asset") -> Column:
    return div(lag_return(close, lag, key), vol)


def individual_reversal(df: DataFrame, lag: int, close="close", vol="vol", out="signal") -> DataFrame:
    return df.withColumn("__z", standardized_return(close, vol, lag)).withColumn(out, -xs.demean("__z")).drop("__z")


def sector_reversal(df: DataFrame, lag: int, close="close", vol="vol", out="signal") -> DataFrame:
    """Minus the sector composite's distance from the mean of sectors, given to every member."""
    z = df.withColumn("__z", standardized_return(close, vol, lag))
    s = xs.sector_average(z, "__z")
    w = W.partitionBy("date")
    s = s.withColumn(out, F.when(F.count(F.lit(1)).over(w) >= 2, -(F.col("__z") - F.avg("__z").over(w)))).drop("__z")
    return df.join(s, ["date", "sector"], "left")


def all_reversals(df: DataFrame, lags=(1, 2, 3), close="close", vol="vol") -> DataFrame:
    """Every tier and lag as rows of one plan: the lags share one sort, the sector tier one aggregate."""
    cols = [f"{n}d" for n in lags]
    z = df.select("asset", "sector", "date", *[standardized_return(close, vol, n).alias(c) for n, c in zip(lags, cols)])
    z = z.unpivot(["asset", "sector", "date"], cols, "lag", "z")
    grp = ("lag", "date", "sector")
    x = z.withColumn("individual", -xs.demean("z", part=grp))
    s = z.groupBy(*grp).agg(F.avg("z").alias("__s"))
    w = W.partitionBy("lag", "date")
    s = s.withColumn("sector_tier", F.when(F.count(F.lit(1)).over(w) >= 2, -(F.col("__s") - F.avg("__s").over(w)))).drop("__s")
    x = x.join(s, list(grp), "left")
    return x.select("asset", "date", F.explode(F.array(
        F.struct(F.concat(F.lit("individual_"), "lag").alias("spec"), F.col("individual").alias("signal")),
        F.struct(F.concat(F.lit("sector_"), "lag").alias("spec"), F.col("sector_tier").alias("signal")))).alias("c")).select("asset", "date", "c.*")


# ---- carry

def carry_smoothed(df: DataFrame, carry: str = "carry", n_months: int = 12, align="label", out="smoothed") -> DataFrame:
    return holding_positions(df, carry, n_months, align=align, out=out)


def timing(carry: str | Column, reference: Column) -> Column:
    """+1 above the reference, -1 otherwise: a missing carry goes short."""
    c = F.col(carry) if isinstance(carry, str) else carry
    return F.when(F.coalesce(c - reference > 0, F.lit(False)), 1.0).otherwise(-1.0)


def carry_specs(df: DataFrame, carry="carry", n_months: int = 12, align="label") -> DataFrame:
    """carry1m, carry1_12, timing against zero and against the sector's expanding mean."""
    x = carry_smoothed(df, carry, n_months, align)
    x = xs.sector_expanding_mean(x, carry, "__ref")
    return x.select("asset", "date", xs.sector_rank(carry).alias("carry1m"), xs.sector_rank("smoothed").alias("carry1_12"),
                    timing(carry, F.lit(0.0)).alias("timing_zero"), timing(carry, F.col("__ref")).alias("timing_mean"))


# ---- cross-sectional momentum and value

def skip_month_momentum(panel: DataFrame, close="close", lookback=12, skip=1, align="label", out="raw") -> DataFrame:
    per = month_ends(panel, close).withColumn("__m", div(month_lag(close, skip), month_lag(close, skip + lookback)) - 1)
    return to_panel(panel, per, "__m", align=align, out=out)


def long_run_value(panel: DataFrame, close="close", end=VALUE_END_MONTHS, window=VALUE_WINDOW_MONTHS, align="label", out="raw") -> DataFrame:
    """log(average price of the months ending `end` months ago / price now)."""
    per = month_ends(panel, close)
    avg = month_mean(close, -(end + window - 1), -end, window)
    per = per.withColumn("__v", safe_log(div(avg, close)))
    return to_panel(panel, per, "__v", align=align, out=out)


def series_table(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """(asset, series) of a map such as BOND_MATURITY or FX_COUNTRY."""
    return spark.createDataFrame(list(names.items()), "asset string, series string")


def yield_change_value(panel: DataFrame, yields: DataFrame, maturity: DataFrame, lag=VALUE_LAG_MONTHS, align="label", out="raw") -> DataFrame:
    """Yield now minus `lag` months ago by maturity; yields(series, date, value), maturity(asset, series)."""
    per = month_ends(yields, "value", "series").withColumn("__c", F.col("value") - month_lag("value", lag, "series"))
    own = panel.join(maturity, "asset")
    return _series_to_assets(own, per, "__c", align, out)


def _series_to_assets(panel: DataFrame, per: DataFrame, value: str, align: str, out: str, limit: int | None = None) -> DataFrame:
    at = "label" if align == "label" else "last_date"
    p = per.select("series", F.col(at).alias("date"), F.col(value).alias("__v"))
    return panel.join(p, ["series", "date"], "left").withColumn(out, ffill("__v", "asset", limit=limit)).drop("__v")


def relative_price_value(panel: DataFrame, cpi: DataFrame, country: DataFrame, home: str, close="close", end=VALUE_END_MONTHS,
                         window=VALUE_WINDOW_MONTHS, lag=VALUE_LAG_MONTHS, limit=FX_FILL_ROWS, align="label", out="raw") -> DataFrame:
    """Long-run value minus inflation relative to home; carried at most `limit` rows."""
    own = panel.join(country, "asset")
    avg = month_mean(close, -(end + window - 1), -end, window, ("asset", "series"))
    px = month_ends(own, close, ("asset", "series")).withColumn("__v", safe_log(div(avg, close)))
    inf = month_ends(cpi, "value", "series").withColumn("__i", safe_log(div("value", month_lag("value", lag, "series"))))
    away = inf.select("series", "idx", "__i")
    base = inf.where(F.col("series") == home).select("idx", F.col("__i").alias("__h"))
    per = px.join(away, ["series", "idx"], "left").join(base, "idx", "left").withColumn("__r", F.col("__v") - (F.col("__i") - F.col("__h")))
    return to_panel(own, per, "__r", limit=limit, align=align, out=out)


def value_panel(default: DataFrame, bond: DataFrame, fx: DataFrame) -> DataFrame:
    """Class-specific measures replace the default, also where they are missing."""
    b = bond.select("asset", "date", F.col("raw").alias("__b"), F.lit("bond").alias("__kb"))
    f = fx.select("asset", "date", F.col("raw").alias("__f"), F.lit("fx").alias("__kf"))
    j = default.join(b, ["asset", "date"], "left").join(f, ["asset", "date"], "left")
    return j.withColumn("raw", F.when(F.col("__kf").isNotNull(), F.col("__f")).when(F.col("__kb").isNotNull(), F.col("__b")).otherwise(F.col("raw"))).drop(
        "__b", "__f", "__kb", "__kf")


# ---- seasonality

def half_month_direction(date: str = "date") -> Column:
    return F.when(F.dayofmonth(date) <= 15, 1.0).otherwise(-1.0)


def half_month(df: DataFrame, close="close", vol="vol", target=0.40, out="signal") -> DataFrame:
    raw = F.when(F.col(close).isNotNull(), half_month_direction())
    return df.withColumn(out, xs.vol_targeted_sign(raw, vol, target))


def same_month_mean(per: DataFrame, ret: str, min_years=5, max_years=20, key="asset", out="score") -> DataFrame:
    """Mean of the earlier occurrences of the same calendar month, today's excluded."""
    m = F.month("label")
    w = W.partitionBy(key, m).orderBy("idx").rowsBetween(-max_years, -1)
    return per.withColumn(out, gated(F.avg(ret), ret, w, min_years))


def same_month_raw(panel: DataFrame, close="close", min_years=5, max_years=20, align="label", out="raw") -> DataFrame:
    """The score moves back one month, so the usual lag lands it on the month it describes."""
    per = month_ends(panel, close).withColumn("__r", div(close, month_lag(close, 1)) - 1)
    per = same_month_mean(per, "__r", min_years, max_years, out="__s").withColumn("__n", F.max("__s").over(months(1, 1)))
    return to_panel(panel, per, "__n", align=align, out=out)


def window_center(first: int, last: int) -> tuple[float, float]:
    """(center day, half width) of a month span; a span may wrap the year end."""
    a, z = MONTH_START[first - 1], MONTH_START[last - 1] + MONTH_DAYS[last - 1] - 1
    if last >= first:
        n = z - a + 1
        return a + n / 2.0, n / 2.0
    n = 365 - a + 1 + z
    return (a + n / 2.0 - 1) % 365 + 1, n / 2.0


def seasonal_weight(df: DataFrame, windows: dict[str, tuple[int, int]] = SEASONAL_WINDOWS, amplitude=0.5, out="weight") -> DataFrame:
    """1 outside an asset's window, rising as a raised cosine to 1 + amplitude at its center."""
    d = F.least(F.dayofyear("date"), F.lit(365)).cast("double")
    w: Column = F.lit(1.0)
    for a, (m0, m1) in windows.items():
        c, h = window_center(m0, m1)
        dist = F.least(F.abs(d - c), 365.0 - F.abs(d - c))
        taper = F.when(dist <= h, 0.5 * (1.0 + F.cos(math.pi * dist / h))).otherwise(0.0)
        w = F.when(F.col("asset") == a, 1.0 + amplitude * taper).otherwise(w)
    return df.withColumn(out, w)
