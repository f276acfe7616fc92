import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from termflow.operators import asof, combos, curve, ingest
from termflow.operators.universe import SECTORS, sector_table

TS = "asset string, date date, contract_symbol string, expiry_year int, expiry_code string, close double, volume double, open double, high double, low double"


def rows(spark, data):
    return spark.createDataFrame([(a, d, s, y, c, p, float(v), p, p, p) for a, d, s, y, c, p, v in data], TS)


def test_chain_order(spark):
    d = dt.date(2020, 1, 6)
    c = rows(spark, [("X", d, "F21", 2021, "F", 1.0, 1), ("X", d, "G20", 2020, "G", 1.0, 1), ("X", d, "F20", 2020, "F", 1.0, 1)])
    got = [r.contract_symbol for r in curve.contract_chain(c).orderBy("chain_idx").collect()]
    assert got == ["F20", "G20", "F21"]


def crossover(spark, extra=0):
    days = [d.date() for d in pd.bdate_range("2020-01-06", periods=10 + extra)]
    data = []
    v1 = [100, 90, 80, 70, 60, 50, 30, 20, 10, 5] + [5] * extra
    v2 = [None, 50, 60, 90, 120, 150, 200, 250, 300, 350] + [400] * extra
    v2 = [None, 50, 60, 65, 120, 150, 200, 250, 300, 350] + [400] * extra
    for d, a, b in zip(days, v1, v2):
        data.append(("X", d, "C1", 2020, "H", 100.0, a))
        if b is not None:
            data.append(("X", d, "C2", 2020, "M", 110.0, b))
    return days, rows(spark, data)


def test_front_rolls_after_two_confirmed_days(spark):
    days, c = crossover(spark, 10)
    f = curve.assign_front(c).orderBy("date").toPandas()
    # First crossover on row 4, confirmed on row 5.
    assert list(f["front_contract_symbol"][:5]) == ["C1"] * 5 and set(f["front_contract_symbol"][5:]) == {"C2"}
    assert set(f["status"]) == {"OK"}


def test_backstop_rolls_near_the_last_observed_date(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-06", periods=12)]
    data = [("X", d, "C1", 2020, "H", 100.0, 100) for d in days[:8]] + [("X", d, "C2", 2020, "M", 110.0, 1) for d in days]
    f = curve.assign_front(rows(spark, data)).orderBy("date").toPandas()["front_contract_symbol"].tolist()
    assert f[:2] == ["C1", "C1"] and f[2:] == ["C2"] * 10
    g = curve.assign_front(rows(spark, [r for r in data if r[1] <= days[7]]), end_guard=True).toPandas()["front_contract_symbol"]
    assert set(g) == {"C1"}


def test_back_adjustment_scales_earlier_bars_by_the_roll_ratio(spark):
    _, c = crossover(spark, 10)
    x = curve.continuous_curve(c).orderBy("date").toPandas()
    assert x["is_roll_date"].sum() == 1
    assert x["adj_close"].iloc[0] == pytest.approx(100 * 110 / 100) and x["adj_close"].iloc[-1] == 110


def test_quoted_carry_and_nearest_leg(spark):
    d = dt.date(2020, 1, 2)
    c = rows(spark, [("X", d, "F20", 2020, "F", 100.0, 1), ("X", d, "H20", 2020, "H", 98.0, 1), ("X", d, "F21", 2021, "F", 95.0, 1)])
    q = spark.createDataFrame([("X", d, "F20", 2020, "F", "H20", 2020, "H", 2.0), ("X", d, "F20", 2020, "F", "F21", 2021, "F", 5.0)],
                              "asset string, date date, near_contract_symbol string, near_expiry_year int, near_expiry_code string, far_contract_symbol string, far_expiry_year int, far_expiry_code string, close double")
    f = spark.createDataFrame([("X", d, "F20")], "asset string, date date, front_contract_symbol string")
    assert curve.real_carry(f, q, c).first().carry == pytest.approx(2 / 100 * 365 / (2 * 30.44))
    assert curve.proxy_carry(f, c).first().carry == pytest.approx(2 / 100 * 365 / (2 * 30.44))
    assert curve.quote_error(f, q, c).first().error == 0


def keys(spark, syms, root="ZC", month=3, year=2025):
    df = spark.createDataFrame([("Corn", root, s, year, month) for s in syms], "asset string, root string, raw_symbol string, maturity_year int, maturity_month int")
    reg = spark.createDataFrame([("ZC", "CBT"), ("ZW", "CBT"), ("CL", "NYM"), ("RB", "NYM"), ("SR3", "CME")], "leg_root string, leg_exchange string")
    return {r.raw_symbol: r for r in combos.resolve_keys(df, reg).collect()}


def legs(r):
    return [x.contract_symbol for x in r.out]


def test_combo_grammars(spark):
    k = keys(spark, ["ZCH5-ZCK5", "H5-K5", "ZC:ZW H5-H5", "ZC:BF H5-K5-N5", "ZC:CF H5K5N5U5", "ZC:AB 2Y H5", "UD:1N: XX", "H5", "H5-Q", "XXH5-XXK5", "ZC:SB PK H5-M5", "ZC:C1 CL-RB H5", "ZC:C1 CL J5-RB H5"])
    assert legs(k["ZCH5-ZCK5"]) == ["ZCH25.CBT", "ZCK25.CBT"] == legs(k["H5-K5"])
    assert legs(k["ZC:ZW H5-H5"]) == ["ZCH25.CBT", "ZWH25.CBT"]
    assert legs(k["ZC:BF H5-K5-N5"]) == ["ZCH25.CBT", "ZCK25.CBT", "ZCN25.CBT"] and k["ZC:BF H5-K5-N5"].bucket == "butterfly"
    assert len(legs(k["ZC:CF H5K5N5U5"])) == 4 and k["ZC:CF H5K5N5U5"].bucket == "condor"
    assert k["ZC:AB 2Y H5"].avg_years == 2 and k["ZC:AB 2Y H5"].bucket == "average"
    assert legs(k["ZC:C1 CL-RB H5"]) == ["CLH25.NYM", "RBH25.NYM"] and legs(k["ZC:C1 CL J5-RB H5"]) == ["RBH25.NYM", "CLJ25.NYM"]
    reasons = {s: k[s].reject_reason for s in ("UD:1N: XX", "H5", "H5-Q", "XXH5-XXK5", "ZC:SB PK H5-M5")}
    assert reasons == {"UD:1N: XX": "user_defined", "H5": "not_2_legs", "H5-Q": "not_2_legs", "XXH5-XXK5": "unknown_root", "ZC:SB PK H5-M5": "leg_parse_fail"}


def test_decade_resolution(spark):
    k = keys(spark, ["ZCH9-ZCK0", "ZCH5-ZCH3", "ZCH24-ZCH25", "ZCK5-ZCN5"], year=2029)
    assert [x.expiry_year for x in k["ZCH9-ZCK0"].out] == [2029, 2030]          # digit wraps past the anchor
    assert [x.expiry_year for x in k["ZCH5-ZCH3"].out] == [2029, 2031]          # tightest span of the two anchors
    assert [x.expiry_year for x in k["ZCH24-ZCH25"].out] == [2024, 2025]        # two digits are absolute
    assert k["ZCK5-ZCN5"].reject_reason == "leg_parse_fail"                     # no leg in the maturity month


def test_pack_only_for_its_root(spark):
    k = keys(spark, ["SR3:SB PK H5-M5"], root="SR3")
    r = k["SR3:SB PK H5-M5"]
    assert r.bucket == "pack" and r.pack_type == "PK" and legs(r) == ["SR3H25.CME", "SR3M25.CME"]


def test_definition_exact_then_backward_fallback(spark):
    D = dt.date
    b = spark.createDataFrame([(D(2020, 1, 1), 1), (D(2020, 1, 2), 1), (D(2020, 1, 3), 1), (D(2020, 1, 2), 2)], "date date, instrument_id long")
    f = spark.createDataFrame([(D(2020, 1, 2), 1, "old", 1), (D(2020, 1, 2), 1, "newer", 2), (D(2020, 1, 9), 2, "late", 1)], "date date, instrument_id long, raw_symbol string, arrival long")
    got = {(r.date.day, r.instrument_id): (r.match, r.raw_symbol) for r in ingest.define_bars(b, f).collect()}
    assert got == {(1, 1): ("none", None), (2, 1): ("exact", "old"), (3, 1): ("fallback", "old"), (2, 2): ("none", None)}


def test_hot_instrument_is_ordered_by_day_not_by_row(spark):
    b = spark.range(20000).select(F.lit(dt.date(2020, 1, 5)).alias("date"), F.lit(1).cast("long").alias("instrument_id"), F.col("id").alias("close"))
    f = spark.createDataFrame([(dt.date(2020, 1, 2), 1, "s", 1)], "date date, instrument_id long, raw_symbol string, arrival long")
    got = ingest.define_bars(b, f)
    assert got.count() == 20000 and got.where("raw_symbol = 's'").count() == 20000


def test_daily_bars_are_defined_without_a_join(spark):
    D = dt.date
    days = [(D(2020, 1, k), i) for i in (1, 2, 3, None) for k in (1, 2, 3, 5)] + [(None, 1)]
    b = spark.createDataFrame([(*k, float(n)) for n, k in enumerate(days)], "date date, instrument_id long, close double")
    f = spark.createDataFrame([(D(2020, 1, 2), 1, "old", 1), (D(2020, 1, 2), 1, "newer", 2), (D(2020, 1, 5), 1, None, 1), (D(2019, 1, 5), 2, "back", 1), (D(2020, 1, 3), 2, "next", 1),
                               (D(2020, 1, 9), 3, "late", 1), (D(2020, 1, 2), None, "lost", 1)], "date date, instrument_id long, raw_symbol string, arrival long")
    want, got = ingest.define_bars(b, f), ingest.define_bars(b, f, one_a_day=True)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_asof_same_day_and_ties(spark):
    D = dt.date
    l = spark.createDataFrame([("a", D(2020, 1, 1)), ("a", D(2020, 1, 5)), ("a", D(2020, 1, 5)), ("b", D(2020, 1, 5))], "k string, date date")
    r = spark.createDataFrame([("a", D(2020, 1, 2), 1.0, 1), ("a", D(2020, 1, 5), 2.0, 1), ("a", D(2020, 1, 5), 3.0, 2)], "k string, t date, v double, o int")
    got = sorted((x.k, x.date.day, x.v) for x in asof.asof_join(l, r, "k", "date", "t", ["v"], "o").collect() if x.v is not None)
    assert got == [("a", 5, 3.0), ("a", 5, 3.0)]
    assert asof.asof_join(l, r, "k", "date", "t", ["v"], "o").count() == 4


def test_publication_lags(spark):
    cal = asof.calendar_for(spark, 2023, 2025)
    m = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 2, 1),)], "ref date")
    got = {r.ref: r.publish_date for r in asof.publish(m, "ref", "business_days", cal, 6).collect()}
    assert got == {dt.date(2024, 1, 1): dt.date(2024, 1, 9), dt.date(2024, 2, 1): dt.date(2024, 2, 9)}
    nxt = asof.publish(m.limit(1), "ref", "next_month", cal, 6).first().publish_date
    assert nxt == dt.date(2024, 2, 9)


def test_regime_defaults_are_neutral(spark):
    D = dt.date
    dates = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 2, 1),)], "date date")
    reg = spark.createDataFrame([(D(2020, 1, 15), "odd")], "date_r date, regime string")
    acts = spark.createDataFrame([("b", "known", False, 0.0)], "book string, regime string, active boolean, alpha_multiplier double")
    got = asof.regime_actions(dates, reg, acts, spark.createDataFrame([("b",), ("c",)], "book string")).collect()
    assert len(got) == 4 and all(r.active and r.alpha_multiplier == 1.0 for r in got)


def test_sector_registry(spark):
    t = sector_table(spark)
    assert t.count() == sum(len(m) for m in SECTORS.values()) == 40 and t.select("sector").distinct().count() == 9


def test_combo_tables_hold_every_venue(spark, sf):
    from termflow.plans import q_ingest
    every = q_ingest.combo_rows(spark, sf).where("asset in ('N5', 'N10')")
    assert combos.bucket_table(every, "spread").count() == 28
    want = every.count()
    assert combos.reject_counts(q_ingest.combo_rows(spark, sf, q_ingest.ice())).where("reject_reason = 'venue_unsupported'").agg(F.sum("row_count")).first()[0] == want
