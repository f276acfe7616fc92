"""Cases beyond the driver tables: later years, large prices, many files, losses of more than all, torn keys."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from termflow.operators import asof, combos, ingest
from termflow.operators import backtest as bt
from termflow.plans import q_stream
from termflow.session import scratch_path
from termflow.sources import driver_views as dv, sinks
from termflow.streaming import ingest as st


def test_calendar_covers_the_data(spark):
    df = spark.createDataFrame([(dt.date(1989, 3, 1),), (dt.date(2000, 3, 1),), (dt.date(2015, 7, 2),)], "ref date")
    cal = asof.calendar_of(df, "ref")
    got = asof.publish(df, "ref", "business_days", cal, 1).orderBy("ref").collect()
    assert [r["publish_date"] for r in got] == [dt.date(1989, 3, 2), dt.date(2000, 3, 2), dt.date(2015, 7, 6)]
    with pytest.raises(Exception, match="does not cover"):
        asof.publish(df, "ref", "business_days", asof.calendar_for(spark, 1990, 2010), 1).collect()


def test_first_price_is_exact_whatever_its_size(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(0, "R")], dv.SCHEMAS["region"]).write.parquet(f"{d}/region.parquet")
    spark.createDataFrame([(0, "N_0", 0)], dv.SCHEMAS["nation"]).write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame([(1, "s", 0, 0.0)], dv.SCHEMAS["supplier"]).write.parquet(f"{d}/supplier.parquet")
    day = dt.datetime(2024, 1, 2)
    line = lambda key, px: (key, 1, 1, 1, 1.0, px, 0.0, 0.0, "A", "F", day)
    spark.createDataFrame([line(5, 200_000.0), line(7, 1.0), line(1 << 45, 2.0)], dv.SCHEMAS["lineitem"]).write.parquet(f"{d}/lineitem.parquet")
    assert dv.bars_d(spark, d).first()["open"] == 200_000.0


@pytest.mark.parametrize("r, want", [([0.1, -1.5, 0.1], [1.1, -0.55, -0.605]), ([0.1, -1.0, 0.5], [1.1, 0.0, 0.0]), ([None, 0.5, -0.5], [1.0, 1.5, 0.75])])
def test_wealth_survives_losses_of_all_or_more(spark, r, want):
    df = spark.createDataFrame([("a", dt.date(2024, 1, i + 1), x) for i, x in enumerate(r)], "k string, date date, r double")
    got = df.select("date", bt.wealth("r", "k").alias("w")).orderBy("date").collect()
    assert [x["w"] for x in got] == pytest.approx(want)
    dd = [x["drawdown"] for x in bt.drawdown(df, "r", "k").orderBy("date").collect()]
    peak = max(want[:1])
    assert dd[0] == pytest.approx(0) and dd[1] == pytest.approx(want[1] / max(peak, want[1]) - 1)


def test_tear_sheet_has_no_rate_for_a_negative_product(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(i), -1.5 if i == 3 else 0.01) for i in range(25)], "k string, date date, pnl double")
    row = bt.performance(df, ["k"]).first()
    assert row["ann_return"] is None and row["max_drawdown"] < -1


def test_streams_read_whole_slices_of_many_files(spark, sf):
    e = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * i), i % 3, "ab"[i % 2], float(i)) for i in range(240)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    end = spark.createDataFrame([(999, dt.datetime(2024, 3, 1), 0, "end", 0.0)], e.schema)
    slices = q_stream.time_slices(e.union(end).repartition(6), 4, "ts")
    bars = spark.read.parquet(st.run_slices(slices, st.daily_bars, spark, name="t")).where("event_type <> 'end'")
    assert bars.agg(F.sum("n")).first()[0] == 240
    sink = st.UpsertSink(scratch_path(spark, "t-up"), ["user_id", "event_type"], "ts")
    st.run_slices(slices, lambda s: s.where("event_type <> 'end'"), spark, sink, "t-up")
    want = {(r["user_id"], r["event_type"]): r["v"] for r in e.groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("v")).collect()}
    assert {(r["user_id"], r["event_type"]): r["value"] for r in sink.table(spark).collect()} == want


def test_combo_rows_with_a_torn_key_are_counted(spark):
    keys = list(combos.KEYS)
    kinds = {"asset": "string", "root": "string", "raw_symbol": "string", "maturity_year": "int", "maturity_month": "int"}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    value = {"asset": "Corn", "root": "ZC", "raw_symbol": "ZCH4-ZCK4", "maturity_year": 2024, "maturity_month": 3}
    rows = spark.createDataFrame([tuple(value[k] for k in keys), tuple(None if k == "maturity_year" else value[k] for k in keys)], schema)
    roots = spark.createDataFrame([("ZC", "XCBT")], "leg_root string, leg_exchange string")
    got = combos.resolve_rows(rows, roots)
    assert got.count() == 2 and {r["reject_reason"]: r["row_count"] for r in combos.reject_counts(got).collect()}.get("incomplete_key") == 1


def test_last_arrival_wins_within_a_part(spark):
    part = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3)], "k string, v int").coalesce(1)
    assert sinks.last_wins([part], ["k"]).first()["v"] == 3


def test_definitions_that_arrive_together_stay_whole(spark):
    d = dt.date(2024, 1, 2)
    defs = spark.createDataFrame([(d, 1, 5, "a", "z"), (d, 1, 5, "b", "y"), (d, 1, 6, "A", "A")], "date date, instrument_id int, arrival int, p string, q string")
    assert tuple(ingest.dedup_definitions(defs).select("p", "q").first()) == ("a", "z")
