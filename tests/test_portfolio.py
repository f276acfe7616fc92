import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import long, noise, same, wide
from termflow.operators import backtest as bt, book, cov, garch, risk, stats


def test_unit_gross_and_one_row_lag(spark):
    idx = pd.date_range("2024-01-01", periods=40)
    s = pd.DataFrame({"A": [1.0] * 20 + [2.0] * 20, "B": [-1.0] * 20 + [-2.0] * 20}, index=idx)
    p = wide(bt.positions(long(spark, s, "s"), "s", "daily"), "pos")
    assert (p.iloc[0] == 0).all() and np.allclose(p.iloc[1:].abs().sum(axis=1), 1)


def test_overlapping_vintages(spark):
    idx = pd.date_range("2024-01-01", periods=90)
    s = pd.DataFrame({"A": np.where(idx.month == 1, 1.0, 3.0)}, index=idx)
    h = wide(bt.holding_positions(long(spark, s, "s"), "s", 2), "held")["A"]
    assert h[pd.Timestamp("2024-03-10")] == 2.0 and np.isnan(h[pd.Timestamp("2024-02-10")])


def test_initial_build_is_free(spark):
    idx = pd.date_range("2024-01-01", periods=3)
    w = pd.DataFrame({"A": [1.0, 1.0, 0.0]}, index=idx)
    c = spark.createDataFrame([("A", 10.0)], "asset string, cost_bps double")
    d = bt.cost_drag(long(spark, w, "pos"), c).orderBy("date").toPandas()["drag"].tolist()
    assert d == [0.0, 0.0, pytest.approx(0.001)]


def test_tiers_are_right_closed_quantiles(spark):
    rows = [(f"a{i}", dt.date(2024, 8, 1), float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8])]
    c = {r.asset: r.cost_bps for r in bt.tiered_cost_bps(spark.createDataFrame(rows, "asset string, date date, volume double"), "2024-01-01").collect()}
    q = pd.qcut(pd.Series([1, 2, 3, 4, 5, 6, 7, 8]), 4, labels=False)
    assert [c[f"a{i}"] for i in range(8)] == [bt.TIER_BPS[3 - int(k)] for k in q]


def test_tiers_with_equal_volumes(spark):
    v = pd.Series([1.0, 1, 1, 1, 1, 5, 6, 7])
    rows = [(f"a{i}", dt.date(2024, 8, 1), x) for i, x in enumerate(v)]
    c = {r.asset: r.cost_bps for r in bt.tiered_cost_bps(spark.createDataFrame(rows, "asset string, date date, volume double"), "2024-01-01").collect()}
    q = pd.qcut(v, 4, labels=False, duplicates="drop")
    assert [c[f"a{i}"] for i in range(8)] == [bt.TIER_BPS[3 - int(k)] for k in q]


def test_split_drops_first_row_only_off_boundary(spark):
    d = [dt.date(2019, 12, 30), dt.date(2019, 12, 31), dt.date(2020, 1, 2), dt.date(2020, 1, 3), dt.date(2022, 1, 3), dt.date(2022, 1, 4)]
    t = bt.split_tag(spark.createDataFrame([(x,) for x in d], "date date"), "2019-12-31", "2021-12-31")
    got = {r.date: r.split for r in t.collect()}
    assert got == {d[0]: "train", d[1]: "train", d[2]: "validation", d[3]: "validation", d[5]: "test"}


def test_tear_sheet_first_day_loss_is_no_drawdown(spark):
    r = [-0.1] + [0.01] * 30
    df = spark.createDataFrame([("s", dt.date(2024, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(r)], "spec string, date date, pnl double")
    p = bt.performance(df, ["spec"]).first()
    assert p.max_drawdown == 0 and p.calmar is None
    assert p.ann_return == pytest.approx(np.prod(1 + np.array(r)) ** (252 / 31) - 1)


def ret_panel(spark, n=160, cols="ABCD", seed=2, gap=0.02):
    rng = np.random.default_rng(seed)
    w = pd.DataFrame(rng.normal(0, 0.01, (n, len(cols))), index=pd.bdate_range("2020-01-01", periods=n), columns=list(cols))
    w = w.mask(rng.random(w.shape) < gap)
    return w, long(spark, w, "ret")


def at_last(c):
    p = c.toPandas()
    p = p[p.rebalance_date == p.rebalance_date.max()]
    return p.pivot(index="i", columns="j", values="cov")


def test_sample_covariance_uses_complete_rows(spark):
    w, p = ret_panel(spark)
    m = at_last(cov.sample_covariance(p, window=60, min_frac=0.5))
    last = w.index[-1]
    want = w.loc[:last].tail(60).dropna().cov()
    np.testing.assert_allclose(m.to_numpy(), want.to_numpy(), rtol=1e-9)


def test_shrinkage_against_the_definition(spark):
    w, p = ret_panel(spark, gap=0)
    m = at_last(cov.shrunk_covariance(p, window=60)).to_numpy()
    x = w.tail(60).to_numpy()
    x = x - x.mean(axis=0)
    n, k = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / k
    d2 = np.linalg.norm(s - mu * np.eye(k)) ** 2 / k
    b2 = min(sum(np.linalg.norm(np.outer(r, r) - s) ** 2 / k for r in x) / n ** 2, d2)
    np.testing.assert_allclose(m, b2 / d2 * mu * np.eye(k) + (1 - b2 / d2) * s, rtol=1e-9)


def test_comovement_matrix_is_symmetric_bounded_and_psd(spark):
    _, p = ret_panel(spark, 400, "ABC", 0, 0.05)
    g = at_last(cov.gerber_correlation(p, window=250)).to_numpy()
    assert np.allclose(g, g.T) and np.all(np.abs(g) <= 1) and np.all(np.diag(g) == 1)
    assert np.linalg.eigvalsh(at_last(cov.gerber_covariance(p, window=250)).to_numpy()).min() > -1e-12
    bad = np.array([[1, .9, -.9], [.9, 1, .9], [-.9, .9, 1.0]])
    fixed = cov.nearest_psd(bad)
    assert np.linalg.eigvalsh(fixed).min() > -1e-10 and np.allclose(np.diag(fixed), 1)


def test_elimination_drops_the_worst_asset():
    m = np.eye(3)
    m[0, 1] = m[1, 0] = m[1, 2] = m[2, 1] = np.nan
    names, v = cov.eliminate_incomplete(["a", "b", "c"], m)
    assert names == ["a", "c"] and not np.isnan(v).any()


def test_risk_parity_two_and_many(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(50, 4))
    c = a.T @ a / 50 * 1e-6
    rows = [("four", str(i), str(j), float(c[i, j])) for i in range(4) for j in range(4)]
    rows += [("two", "a", "a", 0.04), ("two", "b", "b", 0.01), ("two", "a", "b", -0.005), ("two", "b", "a", -0.005)]
    t = spark.createDataFrame(rows, "set_id string, i string, j string, cov double")
    w = risk.risk_parity(t)
    two = {r.i: r.w for r in w.where("set_id = 'two'").collect()}
    assert two["a"] == pytest.approx(1 / 3) and two["b"] == pytest.approx(2 / 3)
    assert all(r.share == pytest.approx(0.25, abs=1e-6) for r in risk.risk_contributions(w, t).where("set_id = 'four'").collect())


def test_budgets_shape_contributions(spark):
    t = spark.createDataFrame([("s", "a", "a", 0.04), ("s", "b", "b", 0.01), ("s", "a", "b", 0.004), ("s", "b", "a", 0.004)], "set_id string, i string, j string, cov double")
    b = spark.createDataFrame([("s", "a", 0.7), ("s", "b", 0.3)], "set_id string, i string, b double")
    got = {r.i: r.share for r in risk.risk_contributions(risk.risk_parity(t, b), t).collect()}
    assert got["a"] == pytest.approx(0.7, abs=1e-6)


def test_tail_risk(spark):
    r = np.random.default_rng(0).normal(size=100)
    df = spark.createDataFrame([("s", dt.date(2020, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(r)], "stream string, date date, pnl double")
    x = risk.historical_tail(df, ["stream"]).first()
    assert x["var"] == pytest.approx(np.quantile(r, 0.05)) and x.es == pytest.approx(r[r <= np.quantile(r, 0.05)].mean())
    e = risk.expanding_tail(df, "stream").orderBy("date").toPandas()
    assert e["var"].isna().sum() == 23 and e["es"].iloc[-1] == pytest.approx(x.es)


def test_expanding_tail_with_ties_and_gaps(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in ("a", "b", "c"):
        v = [None if rng.random() < .15 else float(rng.integers(-3, 4) if k == "b" else 0 if k == "c" else rng.normal()) for _ in range(150)]
        rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(i), x) for i, x in enumerate(v)]
        for i in range(150):
            h = np.array([x for x in v[:i + 1] if x is not None])
            q = np.quantile(h, 0.05) if len(h) >= 24 else None
            want[k, i] = (None, None) if q is None else (q, h[h <= q].mean())
    df = spark.createDataFrame(rows, "stream string, date date, pnl double").repartition(4)
    for r in risk.expanding_tail(df, "stream").collect():
        q, es = want[r.stream, (r.date - dt.date(2020, 1, 1)).days]
        assert (r["var"] is None) == (q is None)
        if q is not None:
            assert r["var"] == pytest.approx(q, abs=1e-12) and r.es == pytest.approx(es, abs=1e-12)


def book_setup(spark, n=30, seed=0, **point):
    rng = np.random.default_rng(seed)
    idx = pd.bdate_range("2020-01-01", periods=n)
    r = pd.DataFrame(rng.normal(0, 0.01, (n, 2)), index=idx, columns=["A", "B"])
    a = pd.DataFrame(rng.normal(0, 1, (n, 2)), index=idx, columns=["A", "B"])
    alpha = long(spark, a, "alpha").withColumn("book", F.lit("b"))
    rows = [(d.date(), i, j, 1e-4 if i == j else 0.0) for d in idx for i in "AB" for j in "AB"]
    x = book.book_inputs(alpha, spark.createDataFrame(rows, "rebalance_date date, i string, j string, cov double"), long(spark, r, "ret"))
    return a, r, x, book.grid(x, [dict(gamma=1.0, kappa=0.1, max_weight=0.5, target_vol=0.10, ppy=252.0, **point)])


def test_book_matches_a_plain_walk(spark):
    a, r, x, pts = book_setup(spark)
    w = wide(book.run_books(x, pts), "w")
    decay, var, prev = 1 - math.exp(-math.log(2) / 87), 0.01 / 252, np.zeros(2)
    for k in range(len(a)):
        if k:
            got = float(prev @ r.iloc[k].to_numpy())
            var = (1 - decay) * var + decay * got ** 2
        y = np.clip((a.iloc[k].to_numpy() + 0.1 * prev) / (1e-4 + 0.1), -0.5, 0.5)
        s = np.clip(min((0.10 / math.sqrt(var * 252)) ** 2, 0.5 / np.abs(y).max()), 0.1, 5)
        prev = np.clip(y * s, -0.5, 0.5)
        np.testing.assert_allclose(w.iloc[k].to_numpy(), prev, rtol=1e-9)
    assert (w.abs().to_numpy() <= 0.5 + 1e-12).all()


def test_book_contributions_sum_and_last_date_earns_nothing(spark):
    a, r, x, pts = book_setup(spark)
    w = book.run_books(x, pts)
    pr = book.period_returns(long(spark, r, "ret"), x.select("book", "date"))
    p = book.book_pnl(w, pr).orderBy("date").toPandas()
    c = book.contributions(w, pr).groupBy("date").agg(F.sum("contribution").alias("c")).orderBy("date").toPandas()
    assert len(p) == len(a) - 1 and np.allclose(p.gross, c.c) and p.turnover.iloc[0] == 0


def test_book_needs_twenty_dates_and_complete_alpha(spark):
    _, _, x, _ = book_setup(spark, 19)
    assert x.count() == 0


def test_garch_book_runs(spark):
    _, _, x, pts = book_setup(spark, 150, garch=True)
    assert book.run_books(x, pts).where("w is null").count() == 0


def test_long_gap_earns_zero(spark):
    D = dt.date
    reb = spark.createDataFrame([("b", D(2020, 1, 1)), ("b", D(2020, 1, 10)), ("b", D(2020, 6, 1))], "book string, date date")
    p = spark.createDataFrame([("A", D(2020, 1, 1), 9.0), ("A", D(2020, 1, 5), 0.1), ("A", D(2020, 1, 10), 0.2), ("A", D(2020, 3, 1), 0.5), ("A", D(2020, 6, 1), 0.5)], "asset string, date date, ret double")
    got = {r.date: r.pr for r in book.period_returns(p, reb).collect()}
    assert got == {D(2020, 1, 1): pytest.approx(0.3), D(2020, 1, 10): 0.0}


def test_garch_recovers_persistence():
    rng = np.random.default_rng(0)
    a, g, b, w = 0.05, 0.10, 0.85, 1e-6
    s2, r = w / (1 - a - b - g / 2), []
    for _ in range(4000):
        x = math.sqrt(s2) * rng.normal()
        r.append(x)
        s2 = w + (a + g * (x < 0)) * x * x + b * s2
    fa, fg, fb, _ = garch.fit(np.array(r))
    assert fa + fb + fg / 2 == pytest.approx(a + b + g / 2, abs=0.04)


def test_walk_forward_vol_ignores_the_future(spark):
    w = noise(160, "A", gap=0.0).pct_change().iloc[1:]
    full = wide(garch.walk_forward_vol(long(spark, w, "r"), "r", 100, 20), "garch_vol")
    part = wide(garch.walk_forward_vol(long(spark, w.iloc[:130], "r"), "r", 100, 20), "garch_vol")
    same(full.loc[part.index], part)


def test_cscv_counts_and_purge(spark):
    dates = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i),) for i in range(800)], "date date")
    b = stats.date_blocks(dates, 8)
    assert {r["count"] for r in b.groupBy("g").count().collect()} == {100}
    s = stats.purged_dates(dates, 8, 4, 5, 5)
    assert s.select("combo").distinct().count() == 70
    n = {(r.combo, r.side): r["count"] for r in s.groupBy("combo", "side").count().collect()}
    # Blocks 0..3 train, 4..7 test: only the tail before the first test block goes.
    assert n[(15, "train")] == 395 and n[(15, "test")] == 400


def test_cscv_dominant_config_is_never_overfit(spark):
    rng = np.random.default_rng(0)
    rows = [(c, dt.date(2020, 1, 1) + dt.timedelta(i), float(rng.normal(m, 0.01))) for c, m in (("good", 0.01), ("x", 0.0), ("y", 0.0), ("z", 0.0)) for i in range(400)]
    res = stats.cscv(spark.createDataFrame(rows, "config string, date date, pnl double"), 8)
    assert res.count() == 70 and {r.winner for r in res.select("winner").distinct().collect()} == {"good"}
    assert stats.pbo(res).first().pbo == 0.0


def test_block_moments_give_the_sharpes_of_the_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(c, dt.date(2020, 1, 1) + dt.timedelta(i), float(rng.normal(1, 0.01)) if c != "flat" else 0.0) for c in ("p", "q", "flat") for i in range(97) if not (c == "q" and i % 5 == 0)]
    pnl = spark.createDataFrame(rows, "config string, date date, pnl double")
    for purge, embargo in ((5, 5), (0, 0), (12, 9)):
        fast = {(r.combo, r.config): (r.is_stat, r.oos_stat) for r in stats.split_stats(pnl, 6, 3, purge, embargo).collect()}
        sides = stats.purged_dates(pnl.select("date").distinct(), 6, 3, purge, embargo)
        x = pnl.join(sides, "date").groupBy("combo", "config").agg(*[stats.sharpe_stat(F.when(F.col("side") == s, F.col("pnl"))).alias(s) for s in ("train", "test")])
        slow = {(r.combo, r.config): (r.train, r.test) for r in x.collect()}
        assert len(fast) == 60
        for k, (a, b) in fast.items():
            u, v = slow.get(k, (None, None))
            assert (a is None) == (u is None) and (b is None) == (v is None)
            assert (a is None or a == pytest.approx(u, rel=1e-9)) and (b is None or b == pytest.approx(v, rel=1e-9))


def test_hac_mean_equals_the_matrix_form(spark):
    x = np.random.default_rng(3).normal(0.1, 1, 200)
    df = spark.createDataFrame([("s", dt.date(2020, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "k string, date date, r double")
    e = x - x.mean()
    s = e @ e + 2 * sum((1 - l / 6) * (e[l:] @ e[:-l]) for l in range(1, 6))
    assert stats.hac_mean(df, "k", "r", 5).first().tstat == pytest.approx(x.mean() / math.sqrt(s / 200 ** 2))


def test_false_discovery_known_case(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = [r.p_adj for r in stats.benjamini_hochberg(df, "p").orderBy("i").collect()]
    assert got == pytest.approx([0.02, 0.04, 0.04, 0.02])
    z = df.select(stats.normal_two_sided(F.lit(1.959964)).alias("p")).first().p
    assert z == pytest.approx(0.05, abs=1e-6)
