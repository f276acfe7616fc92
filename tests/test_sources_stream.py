import datetime as dt

import pandas as pd
from pyspark.sql import Window, functions as F

from tests.helpers import long, wide
from termflow.operators import state as st_state
from termflow.operators.signals import trend
from termflow.session import scratch_path
from termflow.sources import readers, sinks
from termflow.streaming import ingest as st, recursions as rc


def test_upsert_last_wins_and_versions(spark):
    root = scratch_path(spark, "t")
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 1, 2.0)], "k string, d int, v double")
    b = spark.createDataFrame([("y", 1, 9.0), ("z", 1, 3.0)], "k string, d int, v double")
    sinks.upsert(a, root, ["k", "d"], False)
    got = {r.k: r.v for r in sinks.upsert(b, root, ["k", "d"], True).collect()}
    assert got == {"x": 1.0, "y": 9.0, "z": 3.0}


def test_date_comes_from_the_file_name(spark):
    p = scratch_path(spark, "csv")
    for d in ("20240102", "20240103"):
        spark.createDataFrame([(1, 2.0)], "id int, v double").coalesce(1).write.option("header", True).csv(f"{p}/day={d}")
    got = {str(r.date) for r in readers.dated_csv(spark, p + "/*", "id int, v double", r"day=(\d{8})").collect()}
    assert got == {"2024-01-02", "2024-01-03"}


def test_quarterly_fill_is_two_rows(spark):
    w = pd.DataFrame({"AUD": [1.0, None, None, 2.0, None, None]}, index=pd.date_range("2020-01-01", periods=6, freq="MS"))
    got = wide(readers.fill_publishers(long(spark, w, "value", "series")), "value", "series")["AUD"].tolist()
    assert got == [1, 1, 1, 2, 2, 2]


def test_bad_print_is_nulled_and_rows_stay(spark):
    d = dt.date(2024, 6, 17)
    p = spark.createDataFrame([("Rice", d, 999.0), ("Corn", d, 4.0)], "asset string, date date, close double")
    got = {r.asset: r.close for r in readers.mask_bad_prints(p, spark.createDataFrame([("Rice", d)], "asset string, date date"), ["close"]).collect()}
    assert got == {"Rice": None, "Corn": 4.0}


def test_replayed_batch_changes_nothing(spark):
    s = st.UpsertSink(scratch_path(spark, "up"), ["k"], "o")
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 5.0)], "k string, o int, v double")
    b = spark.createDataFrame([("x", 1, 7.0), ("y", 1, 2.0)], "k string, o int, v double")
    s(a, 0), s(b, 1), s(b, 1)
    assert {r.k: r.v for r in s.table(spark).collect()} == {"x": 5.0, "y": 2.0}  # the later order, though an earlier batch


def test_late_rows_are_dropped_past_the_watermark(spark):
    p = scratch_path(spark, "ev")
    schema = "event_id long, ts timestamp, event_type string, value double"
    # A batch filters late rows with the watermark its predecessor ran under.
    t = dt.datetime
    for rows in ([(1, t(2024, 1, 1, 10), "a", 1.0)], [(2, t(2024, 1, 4, 10), "a", 2.0)], [(5, t(2024, 1, 5), "a", 4.0)], [(3, t(2024, 1, 1, 11), "a", 99.0), (4, t(2024, 1, 9), "a", 0.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(p)
    s = st.events(spark, p, spark.createDataFrame([], schema).schema, max_files=1)
    out = spark.read.parquet(st.run_available(st.daily_bars(s), spark)).orderBy("date").collect()
    assert [(r.date.day, r.high, r.n) for r in out][:2] == [(1, 1.0, 1), (4, 2.0, 1)]


def test_cycle_and_refresh_window():
    assert st.cycle_id(dt.date(2024, 1, 4)) == "2023-12-29" and st.cycle_id(dt.date(2024, 1, 5)) == "2024-01-05"
    assert st.refresh_window(dt.date(2024, 1, 10), 7, dt.date(2024, 1, 12)) == (dt.date(2024, 1, 3), dt.date(2024, 1, 12))


def test_last_wins_goes_by_arrival_and_not_by_file(spark):
    rows = [("x", i, float(i)) for i in range(40)]
    new = spark.createDataFrame(rows, "k string, seq int, v double").orderBy("v", ascending=False).repartition(7)
    assert [r.v for r in sinks.last_wins([new], ["k"], "seq").collect()] == [39.0]
    old = spark.createDataFrame([("x", 99, -1.0), ("y", 0, 2.0)], "k string, seq int, v double")
    assert {r.k: r.v for r in sinks.last_wins([old, new], ["k"], "seq").collect()} == {"x": 39.0, "y": 2.0}


def files(spark, root):
    return {r["f"] for r in spark.read.parquet(root).select(F.input_file_name().alias("f")).distinct().collect()}


def test_partitioned_upsert_rewrites_only_what_it_touches(spark):
    t = sinks.PartitionedTable(scratch_path(spark, "pt"), ["k", "d"], F.substring("d", 1, 7))
    schema = "k string, d string, v double, seq int"
    a = spark.createDataFrame([("x", "2024-01-05", 1.0, 0), ("x", "2024-02-05", 2.0, 0), ("y", "2024-02-06", 3.0, 0), (None, None, 8.0, 0)], schema)
    assert t.upsert(a, 1, "seq") == ["", "2024-01", "2024-02"]
    before = files(spark, t.root)
    # one batch over many files: the row of the largest arrival stays, wherever it lies
    b = spark.createDataFrame([("x", "2024-02-05", float(i), i) for i in (3, 9, 1, 7)] + [("z", "2024-03-01", 5.0, 0)], schema).repartition(5)
    assert t.upsert(b, 2, "seq") == ["2024-02", "2024-03"]
    after = files(spark, t.root)
    same = {f for f in before if "2024-01" in f or "HIVE" in f}
    assert len(same) == 2 and same <= after and not {f for f in before if "2024-02" in f} & after
    want = {("x", "2024-01-05"): 1.0, ("x", "2024-02-05"): 9.0, ("y", "2024-02-06"): 3.0, ("z", "2024-03-01"): 5.0, (None, None): 8.0}
    assert {(r.k, r.d): r.v for r in t.read(spark).collect()} == want
    for batch, n in ((b, 2), (a, 1)):  # replays, in whichever order
        t.upsert(batch, n, "seq")
        assert {(r.k, r.d): r.v for r in t.read(spark).collect()} == want
    assert t.upsert(b.limit(0), 3, "seq") == [] and set(t.read(spark).columns) == {"k", "d", "v"}


def test_parts_are_compacted_up_to_the_committed_batch(spark):
    s = st.UpsertSink(scratch_path(spark, "up"), ["k"], "o", compact_every=2, buckets=3)
    schema = "k string, o int, v double"
    batches = [[("x", 5, 1.0), ("y", 1, 1.0)], [("x", 2, 7.0), ("z", 1, 2.0)], [("y", 4, 9.0)], [("x", 6, 3.0), ("x", 5, 0.0)], [("w", 1, 4.0)]]
    want = {}
    for i, rows in enumerate(batches):
        s(spark.createDataFrame(rows, schema), i)
        for k, o, v in rows:
            if k not in want or o >= want[k][0]:
                want[k] = (o, v)
        assert {r.k: (r.o, r.v) for r in s.table(spark).collect()} == want
    assert s.compacted(spark) == 3 and {r.k for r in s.parts(spark, 3).collect()} == {"w"}
    s(spark.createDataFrame(batches[4], schema), 4)  # replayed after its compaction
    s.compact(spark, 3)
    assert {r.k: (r.o, r.v) for r in s.table(spark).collect()} == want


def test_refresh_takes_the_overlap_again(spark):
    src = spark.createDataFrame([(dt.date(2024, 1, i),) for i in range(1, 20)], "date date")
    got = st.pull(src, dt.date(2024, 1, 10), 3, dt.date(2024, 1, 16)).collect()
    assert [r.date.day for r in got] == list(range(7, 17)) and {r.cycle for r in got} == {"2024-01-12"}


D0 = dt.date(2024, 1, 1)


def drain(spark, slices, make):
    with st.state_layout(spark, rocks=True):
        return spark.read.parquet(st.run_slices(slices, make, spark))


def test_disordered_rows_fold_in_date_order(spark):
    days = [D0 + dt.timedelta(days=i) for i in range(30)]
    close = [100.0, 101.0, None, 103.0, 99.0] * 6
    rows = [("a", d, c) for d, c in zip(days, close)] + [("b", d, None if i % 7 == 0 else 50.0 + i) for i, d in enumerate(days)]
    schema = "asset string, date date, close double"
    late = [r for i, r in enumerate(rows) if i % 3 == 0]
    first = [r for i, r in enumerate(rows) if i % 3 and r[1] < days[15]]
    rest = [r for i, r in enumerate(rows) if i % 3 and r[1] >= days[15]]
    wrong = [("a", days[20], 1e6)]  # a date sent twice: what arrives later counts
    end = [("~", days[-1] + dt.timedelta(days=200), 1.0)]
    slices = [spark.createDataFrame(x, schema).repartition(3) for x in (first + wrong, rest[::-1], late + end)]
    want = st_state.ewma_vol(spark.createDataFrame(rows, schema).withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("asset").orderBy("date")) - 1), "r", 5, 252)
    got = drain(spark, slices, lambda s: rc.ewma(s, 5, "60 days")).where("asset <> '~'").select("asset", "date", F.sqrt(F.col("ewma_var") * 252).alias("g"))
    j = got.join(want, ["asset", "date"], "full").collect()
    assert len(j) == 60 and all((r.g is None) == (r.ewma_vol is None) and (r.g is None or abs(r.g - r.ewma_vol) < 1e-12) for r in j)
    ch = trend.donchian_channels(spark.createDataFrame(rows, schema), [4, 2])
    want = {(r.asset, r.date): r.state for r in st_state.donchian_states(ch, [(4, 2)]).collect()}
    got = {(r.asset, r.date): r.state for r in drain(spark, slices, lambda s: rc.channel(s, [(4, 2)], "60 days")).where("asset <> '~'").collect()}
    assert got == want and {1.0, -1.0, 0.0} & set(want.values())


def test_rows_beyond_the_watermark_do_not_reach_the_fold(spark):
    schema = "asset string, date date, close double"
    day = lambda n: D0 + dt.timedelta(days=n)
    slices = [[("a", day(0), 1.0), ("a", day(10), 2.0)], [("a", day(40), 3.0)], [("a", day(1), 9.0), ("~", day(300), 1.0)]]
    got = drain(spark, [spark.createDataFrame(x, schema).coalesce(1) for x in slices], lambda s: rc.ewma(s, 5, "5 days")).where("asset <> '~'")
    assert sorted((r.date, r.ret) for r in got.collect() if r.ret is not None) == [(day(10), 1.0), (day(40), 0.5)]
