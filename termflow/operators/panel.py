"""Panel operators: densify, pivot, gap-safe returns, calendar resampling."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from termflow.functions.calendar import month_idx, period_label
from termflow.functions.cols import col, div, ffill, keys, seq


def densify(bars: DataFrame, key="asset", dims: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """Union calendar x keys, missing cells NULL.

    The calendar is one array of distinct dates (its size is set by the calendar, not the data),
    handed to every key as a scalar subquery and exploded in parallel: no join between the two.
    """
    k = keys(key)
    cal = bars.agg(F.array_sort(F.collect_set(date)).alias("c"))
    grid = bars.select(*k, *dims).distinct().select(*k, *dims, F.explode(cal.scalar()).alias(date))
    return grid.join(bars.drop(*dims), [*k, date], "left")


def pivot_field(panel: DataFrame, field: str, assets: list[str]) -> DataFrame:
    """Wide frame for presentation; the column list is given, so no extra pass finds it."""
    return panel.groupBy("date").pivot("asset", assets).agg(F.first(field, ignorenulls=True))


def simple_return(x: str | Column, key="asset", order="date") -> Column:
    """x / previous panel row - 1; NULL across a gap."""
    return div(x, F.lag(col(x)).over(seq(key, order))) - 1


def period_last(panel: DataFrame, value: str, freq: str, key="asset") -> DataFrame:
    """(key, label, idx, value): last non-null value of each calendar period."""
    lab = period_label("date", freq)
    return (
        panel.groupBy(*keys(key), lab.alias("label"))
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("date"))).alias(value),
             F.max("date").alias("last_date"))
        .withColumn("idx", month_idx("label") if freq == "monthly" else F.datediff("label", F.lit("1970-01-02")) / 7)
        .withColumn("idx", F.col("idx").cast("int"))
    )


def spread_to_panel(panel: DataFrame, per: DataFrame, value: str, key="asset", align: str = "label",
                    limit: int | None = None, out: str | None = None) -> DataFrame:
    """Place period values on panel rows and carry them forward.

    align="label": only labels that are panel rows take effect (a month ending on a day the panel
    lacks is lost). align="last_trading_day": the period's last panel row takes the value.
    """
    out = out or value
    k = keys(key)
    at = "label" if align == "label" else "last_date"
    p = per.select(*k, F.col(at).alias("date"), F.col(value).alias("__v"))
    j = panel.join(p, [*k, "date"], "left")
    return j.withColumn(out, ffill("__v", key, limit=limit)).drop("__v")


def resample_ffill(panel: DataFrame, value: str, freq: str, key="asset", align: str = "label",
                   out: str | None = None) -> DataFrame:
    if freq == "daily":
        return panel.withColumn(out or value, F.col(value))
    return spread_to_panel(panel, period_last(panel, value, freq, key), value, key, align, out=out)
