import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tests.helpers import long, noise, same, wide
from termflow.functions.cols import avg_rank, ffill, gated, trailing
from termflow.functions.calendar import business_days, week_end
from termflow.operators import panel as op


def test_densify_fills_the_union_calendar(spark):
    rows = [("A", dt.date(2020, 1, 1), 1.0), ("B", dt.date(2020, 1, 2), 2.0)]
    d = op.densify(spark.createDataFrame(rows, "asset string, date date, close double"))
    assert d.count() == 4 and d.where("close is null").count() == 2
    assert "Cartesian" not in d._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in d._jdf.queryExecution().toString()


def test_returns_do_not_bridge_gaps(spark):
    w = noise(40, gap=0.2)
    got = wide(long(spark, w).withColumn("r", op.simple_return("close")), "r")
    same(w.pct_change(fill_method=None), got)


def test_rolling_gate_matches_pandas(spark):
    w = noise(60, gap=0.3)
    t = trailing(10)
    got = wide(long(spark, w).withColumn("s", gated(F.stddev_samp("close"), "close", t, 7)), "s")
    same(w.rolling(10, min_periods=7).std(), got)


def test_average_rank_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", None)], "k string, x double").withColumn("g", F.lit(1))
    got = {r.k: r.r for r in df.select("k", avg_rank("x", "g").alias("r")).collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 3.0, "d": None}


def test_fill_limit_counts_rows(spark):
    w = pd.DataFrame({"A": [1.0, None, None, None, 5.0, None]}, index=pd.date_range("2020-01-01", periods=6))
    same(w.ffill(limit=2), wide(long(spark, w).withColumn("f", ffill("close", limit=2)), "f"))


def test_month_label_is_lost_when_the_month_ends_off_panel(spark):
    w = noise(130, gap=0.0)
    got = wide(op.resample_ffill(long(spark, w), "close", "monthly", out="h"), "h")
    same(w.resample("ME").last().reindex(w.index).ffill(), got)


def test_last_trading_day_alignment_keeps_every_month(spark):
    w = noise(130, gap=0.0)
    got = wide(op.resample_ffill(long(spark, w), "close", "monthly", align="last_trading_day", out="h"), "h")
    ends = w.groupby(w.index.to_period("M")).tail(1)
    same(ends.reindex(w.index).ffill(), got)


def test_weekly_label(spark):
    w = noise(40, gap=0.2)
    same(w.resample("W-FRI").last().reindex(w.index).ffill(), wide(op.resample_ffill(long(spark, w), "close", "weekly", out="h"), "h"))


def test_week_end_is_friday(spark):
    r = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-14')) as d").select("d", week_end("d").alias("w")).collect()
    assert all(x.w.weekday() == 4 and 0 <= (x.w - x.d).days <= 6 for x in r)


def test_business_day_dimension(spark):
    c = {r.date: r for r in business_days(spark, 2023, 2024).collect()}
    assert not c[dt.date(2024, 1, 1)].is_bday and not c[dt.date(2024, 7, 4)].is_bday and not c[dt.date(2024, 11, 28)].is_bday
    assert not c[dt.date(2023, 11, 10)].is_bday  # Saturday holiday observed on Friday
    assert c[dt.date(2024, 1, 2)].is_bday
