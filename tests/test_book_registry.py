"""Flavours, registered books and the pair book on small panels."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import long, noise
from termflow.operators import registry
from termflow.operators.panel import simple_return
from termflow.operators.vol import realized_vol


@pytest.fixture(scope="module")
def flavours(spark):
    w = noise(260, "ABC", seed=3, gap=0.03)
    p = long(spark, w).withColumn("sector", F.lit("s")).withColumn("ret", simple_return("close"))
    p = p.withColumn("vol", realized_vol("ret", 20, ppy=252))
    out = registry.trend_flavours(p, {"A": (1, 3)}, 12, (4, 12), 0.4, (0.5, 40, 20), 60).toPandas()
    return {f: g.pivot(index="date", columns="asset", values="signal") for f, g in out.groupby("flavour")}


def test_every_flavour_has_a_row_per_panel_row(flavours):
    assert set(flavours) == set(registry.FLAVOURS) and all(v.shape == (260, 3) for v in flavours.values())


def test_flavours_keep_their_relations(flavours):
    m, e, f = (flavours[k].astype(float) for k in ("tsmom_alone", "equal_weight", "fixed_70_30"))
    cross = 2 * e - m
    np.testing.assert_allclose(f.to_numpy(), (0.7 * m + 0.3 * cross).to_numpy(), atol=1e-12)
    for k in ("ic_weighted", "risk_parity"):  # a weighted mean lies between its parts
        v = flavours[k].astype(float)
        lo, hi = np.minimum(m, cross) - 1e-12, np.maximum(m, cross) + 1e-12
        assert (((v >= lo) & (v <= hi)) | v.isna()).all().all() and v.notna().sum().sum() > 300
    c = flavours["confirmation"].astype(float)
    same = np.sign(m) == np.sign(cross)
    np.testing.assert_allclose(c.where(m.notna()).to_numpy(), m.where(same, 0.0).where(m.notna()).to_numpy(), atol=1e-12)
    d = flavours["tsmom_deadband"].astype(float)
    assert (((d == 0) | np.isclose(d, m)) | d.isna()).all().all() and (d == 0).sum().sum() > 50
    s = flavours["tsmom_seasonal"].astype(float)
    ratio = (s / m).where(m != 0)
    assert (ratio[["B", "C"]].stack() == 1).all() and ratio["A"].max() > 1.4 and ratio["A"].min() >= 1


def test_registered_books_scale_and_choose(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(20)]
    r = np.random.default_rng(0)
    rows = [(s, a, d, None if a == "thin" and i % 4 else 0.01, None if a == "mute" else float(r.normal())) for s in ("x", "y") for a in ("a", "b", "thin", "mute", "out") for i, d in enumerate(days)]
    sig = spark.createDataFrame(rows, "spec string, asset string, date date, ret double, signal double")
    books = spark.createDataFrame([("one", "x"), ("two", "y"), ("flat", "z")], "book string, spec string")
    members = spark.createDataFrame([(b, a) for b in ("one", "two") for a in ("a", "b", "thin", "mute")], "book string, asset string")
    got = registry.registered_books(sig, books, members, "2024-01-12").toPandas()
    assert set(zip(got.book, got.asset)) == {(b, a) for b in ("one", "two") for a in "ab"}
    want = pd.DataFrame(rows, columns=["spec", "asset", "date", "ret", "signal"])
    for b, s in (("one", "x"), ("two", "y")):
        v = want[(want.spec == s) & want.asset.isin(["a", "b"])]
        sd = v[v.date <= dt.date(2024, 1, 12)].signal.std()
        g = got[got.book == b].set_index(["asset", "date"]).alpha
        np.testing.assert_allclose(g.loc[list(zip(v.asset, v.date))].to_numpy(), (v.signal / sd).to_numpy())


def test_leg_costs_count_a_missing_leg_as_free(spark):
    legs = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a"), ("q", "gone")], "pair string, asset string")
    cost = spark.createDataFrame([("a", 3.0), ("b", 10.0)], "asset string, cost_bps double")
    assert {r.pair: r.cost_bps for r in registry.leg_costs(legs, cost).collect()} == {"p": 13.0, "q": 3.0}


def test_spec_sharpes_trade_each_key_alone(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    r = np.random.default_rng(1)
    ret = r.normal(0, 0.01, 90)
    rows = [("p", s, d, float(ret[i]), float(x)) for s, f in (("good", 5.0), ("bad", -0.1)) for i, (d, x) in enumerate(zip(days, f * np.append(ret[1:], 0)))]
    t = spark.createDataFrame(rows, "pair string, spec string, date date, ret double, signal double")
    got = {x.spec: x for x in registry.spec_sharpes(t, spark.createDataFrame([("p", 100.0)], "pair string, cost_bps double"), "2024-02-10", "2024-03-10", "daily").collect()}
    pos = np.append(0, np.sign(ret[1:]))  # yesterday's signal has today's sign, at unit size
    cost = np.append(0, np.abs(np.diff(pos))) * 100 / 10_000
    pnl = (pos * ret - cost)[:41]
    assert got["good"].train == pytest.approx(pnl.mean() / pnl.std(ddof=1) * 252 ** 0.5) and got["bad"].train < 0


def test_named_universes_fit_their_operators(spark):
    from termflow.operators import universe
    from termflow.operators.signals import cross_section, relative_value as rv
    every = universe.sector_table(spark).select("asset")
    trend = {r.asset for r in universe.compress(every, universe.redundant_table(spark), "trend").collect()}
    rank = {r.asset for r in universe.compress(every, universe.redundant_table(spark), "rank").collect()}
    assert rank - trend == {"Brent", "KC_Wheat"} and not {"Dow", "UltraBond", "US_5Y"} & rank
    bars = every.select("asset", F.lit("2024-01-02").cast("date").alias("date"), F.lit(1e6).alias("volume"))
    inside = {r.asset for r in universe.liquid_universe(bars, "2024-01-01", 1000.0, universe.blocked_table(spark)).where("included").collect()}
    assert {r.asset for r in every.collect()} - inside == {"Coffee", "Cotton", "OrangeJuice"}
    legs = rv.pair_registry(spark)
    assert legs.count() == 10 and rv.pair_registry(spark, True).count() == 4 and rv.pair_registry(spark, False).count() == 6
    known = {r.asset for r in every.collect()}
    assert {x for r in legs.collect() for x in (r.leg_y, r.leg_x)} <= known and {r.asset for r in universe.proxy_table(spark).collect()} <= known
    for names in (cross_section.BOND_MATURITY, cross_section.FX_COUNTRY):
        assert {(r.asset, r.series) for r in cross_section.series_table(spark, names).collect()} == set(names.items()) and set(names) <= known
    day = spark.createDataFrame([("Corn", dt.date(2024, 7, 16)), ("Gold", dt.date(2024, 7, 16))], "asset string, date date")
    assert {r.asset: round(r.weight, 2) for r in cross_section.seasonal_weight(day).collect()} == {"Corn": 1.5, "Gold": 1.0}
