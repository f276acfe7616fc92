import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import long, noise, same, wide
from termflow.operators import combine, state, vol, xs
from termflow.operators.signals import cross_section as cs, relative_value as rv, trend


def joined(spark, **wides):
    out = None
    for n, w in wides.items():
        x = long(spark, w, n)
        out = x if out is None else out.join(x, ["asset", "date"])
    return out


def test_yang_zhang_flat_prices_are_zero(spark):
    idx = pd.date_range("2020-01-01", periods=20)
    w = pd.DataFrame({"A": [100.0] * 20}, index=idx)
    v = wide(vol.yang_zhang(joined(spark, open=w, high=w, low=w, close=w), 5), "vol")
    assert (v["A"].dropna() == 0).all() and v["A"].notna().any()


def test_yang_zhang_survives_a_negative_print(spark):
    w = noise(20, "A", gap=0)
    bad = w.copy()
    bad.iloc[10] = -5.0
    v = wide(vol.yang_zhang(joined(spark, open=bad, high=bad + 1, low=bad - 1, close=bad), 5), "vol")
    assert np.isfinite(v["A"].dropna()).all()


def test_roll_day_adds_no_overnight_return(spark):
    o = noise(30, "A", gap=0)
    j = o.copy()
    j.iloc[15:] *= 3
    roll = pd.DataFrame({"A": [0.0] * 30}, index=o.index)
    roll.iloc[15] = 1.0
    a = joined(spark, open=o, high=o, low=o, close=o, roll=roll).withColumn("roll", F.col("roll") > 0)
    b = joined(spark, open=j, high=j, low=j, close=j, roll=roll).withColumn("roll", F.col("roll") > 0)
    same(wide(vol.yang_zhang(a, 8, roll="roll"), "vol"), wide(vol.yang_zhang(b, 8, roll="roll"), "vol"))


def test_forward_variance_looks_ahead_and_needs_every_row(spark):
    w = noise(12, "A", gap=0).pct_change()
    got = wide(long(spark, w, "r").withColumn("f", vol.forward_variance("r", 3)), "f")["A"]
    want = (w["A"] ** 2)[::-1].rolling(3).sum()[::-1].shift(-1) * 252 / 3
    np.testing.assert_allclose(got, want, equal_nan=True)


def test_qlike_is_zero_at_equality(spark):
    r = spark.range(1).select(vol.qlike(F.lit(0.04), F.lit(0.04)).alias("a"), vol.qlike(F.lit(0.0), F.lit(0.04)).alias("b")).first()
    assert r.a == 0 and r.b is None


def test_ewma_vol_matches_pandas_with_gaps(spark):
    r = noise(50, gap=0.3).pct_change(fill_method=None)
    want = np.sqrt((r ** 2).ewm(com=10, adjust=False).mean() * 252)
    same(want, wide(state.ewma_vol(long(spark, r, "r"), "r", 10), "ewma_vol"))


def test_deadband_warm_up_is_flat_and_missing_stays_missing(spark):
    m = noise(60, "A", gap=0.1) - 100
    got = wide(xs.deadband(joined(spark, m=m, v=m * 0 + 0.2), "m", "v", 1.0, 0.5, 20, 10), "signal")
    thr = m.abs().rolling(20, min_periods=10).quantile(0.5).shift(1)
    want = (np.sign(m) / 0.2).where(m.abs() >= thr, 0.0).where(m.notna())
    same(want, got)


def test_single_member_sector_has_no_rank(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1), "s", 1.0), ("B", dt.date(2020, 1, 1), "t", 1.0), ("C", dt.date(2020, 1, 1), "t", 2.0)], "asset string, date date, sector string, x double")
    got = {r.asset: r.s for r in df.select("asset", xs.sector_rank("x").alias("s")).collect()}
    assert got == {"A": None, "B": -0.5, "C": 0.5}


def test_momentum_skip(spark):
    w = noise(60, gap=0.1)
    got = wide(long(spark, w).withColumn("m", trend.raw_momentum_rows("close", 10, 3)), "m")
    same(w.shift(3) / w.shift(13) - 1, got)


def test_donchian_against_a_plain_loop(spark):
    w = noise(120, "A", gap=0.05, seed=3)
    ch = trend.donchian_channels(long(spark, w), [10, 5])
    got = wide(state.donchian_states(ch, [(10, 5)]), "state")["A"]
    p = w["A"]
    hi, lo, xh, xl = (p.shift(1).rolling(n).agg(f) for n, f in ((10, "max"), (10, "min"), (5, "max"), (5, "min")))
    st, want = 0.0, []
    for i in range(len(p)):
        if np.isnan(p.iloc[i]) or np.isnan(hi.iloc[i]):
            want.append(np.nan)
            continue
        if st == 0:
            st = 1.0 if p.iloc[i] > hi.iloc[i] else -1.0 if p.iloc[i] < lo.iloc[i] else 0.0
        elif (st > 0 and p.iloc[i] < xl.iloc[i]) or (st < 0 and p.iloc[i] > xh.iloc[i]):
            st = 0.0
        want.append(st)
    np.testing.assert_array_equal(got.to_numpy(), np.array(want))


def test_threshold_band_windows_equal_the_state_loop(spark):
    rng = np.random.default_rng(5)
    z = pd.DataFrame({c: rng.normal(0, 1.5, 200) for c in "ABC"}, index=pd.date_range("2020-01-01", periods=200)).mask(rng.random((200, 3)) < 0.1)
    got = wide(rv.threshold_band(long(spark, z, "z", "pair"), "z", 2.0, 0.5), "state", "pair")
    for c in z:
        st, want = 0.0, []
        for v in z[c]:
            if np.isnan(v):
                want.append(np.nan)
                continue
            if st == 0:
                st = -1.0 if v > 2 else 1.0 if v < -2 else 0.0
            elif abs(v) < 0.5:
                st = 0.0
            want.append(st)
        np.testing.assert_array_equal(got[c].to_numpy(), np.array(want))


def test_carry_missing_goes_short(spark):
    r = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (None,)], "c double").select(cs.timing("c", F.lit(0.0)).alias("t")).collect()
    assert [x.t for x in r] == [1.0, -1.0, -1.0, -1.0]


def test_long_run_value_hand_case(spark):
    w = pd.DataFrame({"A": [100.0 + i for i in range(70)]}, index=pd.date_range("2015-01-31", periods=70, freq="ME"))
    got = wide(cs.long_run_value(long(spark, w)), "raw")["A"].iloc[-1]
    p = w["A"].to_numpy()
    assert got == pytest.approx(math.log(p[4:16].mean() / p[69]))


def test_half_month_days(spark):
    d = [dt.date(2020, 1, x) for x in (1, 15, 16, 31)]
    r = spark.createDataFrame([(x,) for x in d], "date date").select(cs.half_month_direction().alias("h")).collect()
    assert [x.h for x in r] == [1.0, 1.0, -1.0, -1.0]


def test_seasonal_weight_wraps_the_year(spark):
    df = spark.sql("select 'G' as asset, explode(sequence(date'2021-01-01', date'2021-12-31')) as date")
    w = cs.seasonal_weight(df, {"G": (11, 3)}).toPandas().set_index("date")["weight"]
    assert w.max() == pytest.approx(1.5, abs=1e-3) and w.min() == 1.0
    assert w[dt.date(2021, 1, 15)] > 1.45 and w[dt.date(2021, 7, 1)] == 1.0


def test_kalman_hedge_tracks_a_constant_slope(spark):
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(0, 0.02, 400)) + 4
    y = 0.5 + 1.5 * x + rng.normal(0, 0.001, 400)
    idx = pd.date_range("2020-01-01", periods=400)
    df = long(spark, pd.DataFrame({"p": y}, index=idx), "y", "pair").join(long(spark, pd.DataFrame({"p": x}, index=idx), "x", "pair"), ["pair", "date"])
    out = state.kalman_hedge(df, "y", "x").toPandas().sort_values("date")
    assert out["beta"].head(60).isna().all() and out["beta"].notna().sum() == 340
    fit = out["alpha"].iloc[-1] + out["beta"].iloc[-1] * x[-1]
    assert fit == pytest.approx(y[-1], abs=0.01)


def test_cointegrated_pair_rejects_more_often(spark):
    rng = np.random.default_rng(0)
    n = 600
    idx = pd.date_range("2018-01-01", periods=n)
    x = np.cumsum(rng.normal(size=n))
    frames = {"tied": (2 * x + rng.normal(size=n), x), "free": (np.cumsum(rng.normal(size=n)), x)}
    rows = [(p, d.date(), float(a), float(b)) for p, (ys, xs_) in frames.items() for d, a, b in zip(idx, ys, xs_)]
    df = spark.createDataFrame(rows, "pair string, date date, y double, x double")
    t = state.engle_granger(df, "y", "x", 250, 50).toPandas()
    assert (t.groupby("pair").size() == 8).all()
    share = t.assign(r=t.pvalue < 0.05).groupby("pair")["r"].mean()
    assert share["tied"] > 0.9 > share["free"]


def test_tau_pvalue_at_the_published_five_percent_point():
    assert state.tau_pvalue(-3.34) == pytest.approx(0.05, abs=0.003)
    assert state.tau_pvalue(5) == 1.0 and state.tau_pvalue(-30) == 0.0


def test_half_life_of_a_known_process(spark):
    rng = np.random.default_rng(1)
    phi, s = 2 ** (-1 / 20), [0.0]
    for e in rng.normal(size=2999):
        s.append(phi * s[-1] + e)
    w = pd.DataFrame({"p": s, "up": np.arange(3000.0) ** 1.5}, index=pd.date_range("2010-01-01", periods=3000))
    h = {r.pair: r.half_life for r in rv.full_half_life(long(spark, w, "spread", "pair"), "2030-01-01").collect()}
    assert 14 < h["p"] < 28 and h["up"] is None


def test_rolling_half_life_equals_least_squares(spark):
    w = noise(150, "A", gap=0.1, seed=4)
    got = rv.rolling_half_life(long(spark, w, "spread", "pair"), window=60, step=20).toPandas().sort_values("date")
    s = w["A"].dropna()
    want = []
    for i in range(60, len(s) + 1, 20):
        x = s.iloc[i - 60:i]
        d = x.diff()
        f = pd.DataFrame({"y": d, "l": x.shift(1), "k": d.shift(1)}).dropna()
        b, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(f)), f.l, f.k]), f.y, rcond=None)
        want.append(b[1])
    np.testing.assert_allclose(got["lambda"], want, rtol=1e-6)


def test_blend_needs_every_signal(spark):
    rows = [("A", dt.date(2020, 1, 1), "x", 1.0), ("A", dt.date(2020, 1, 1), "y", 3.0), ("B", dt.date(2020, 1, 1), "x", 1.0), ("B", dt.date(2020, 1, 1), "y", None)]
    r = {x.asset: x.alpha for x in combine.blend(spark.createDataFrame(rows, "asset string, date date, spec string, signal double"), 2).collect()}
    assert r == {"A": 2.0, "B": None}


def test_half_life_to_window(spark):
    r = spark.createDataFrame([(5.0,), (1.25,), (1000.0,), (-1.0,), (None,)], "h double").select(rv.half_life_window("h", fallback=63).alias("w")).collect()
    assert [x.w for x in r] == [10, 10, 252, 63, 63]


@pytest.mark.parametrize("cut", [60, 90])
def test_no_lookahead(spark, cut):
    w = noise(120, "AB", gap=0.1, seed=9)

    def run(x):
        p = long(spark, x).withColumn("vol", vol.realized_vol("close", 10))
        p = p.withColumn("m", trend.raw_momentum_rows("close", 10)).withColumn("z", xs.continuous("m", "vol"))
        p = xs.deadband(p, "m", "vol", 1.0, 0.5, 20, 10, out="d")
        return wide(p, "z"), wide(p, "d")
    for full, part in zip(run(w), run(w.iloc[:cut])):
        same(full.iloc[:cut], part)
