"""Grid tests against the default, corrections, winners by key, upsert of the whole transform."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termflow.operators import combos, stats, tuning


def test_normal_tail_as_a_column(spark):
    z = [None, 0.0, 1e-9, 0.3, -1.0, 1.959964, 2.9999, 3.0, -3.0001, 5.0, 8.5, 20.0, 37.0]
    got = [r.p for r in spark.createDataFrame([(i, v) for i, v in enumerate(z)], "i int, z double").orderBy("i").select(stats.normal_two_sided(F.col("z")).alias("p")).collect()]
    assert got[0] is None
    for v, p in zip(z[1:], got[1:]):
        assert p == pytest.approx(math.erfc(abs(v) / math.sqrt(2)), rel=1e-9)


def hac(x, lags):
    e = np.asarray(x) - np.mean(x)
    s = e @ e + sum(2 * (1 - l / (lags + 1)) * (e[l:] @ e[:-l]) for l in range(1, lags + 1))
    return np.mean(x), np.mean(x) * len(x) / math.sqrt(s)


def streams(r, n=60):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    base = r.normal(size=n)
    return days, {"d": base, "same": base.copy(), "up": base + .2 + r.normal(size=n) * .1, "down": base - .1 + r.normal(size=n) * .3, "short": base + 1}


def test_paired_differences_against_the_default(spark):
    days, s = streams(np.random.default_rng(4))
    rows = [("b", k, d, float(x)) for k, v in s.items() for i, (d, x) in enumerate(zip(days, v)) if not (k == "short" and i >= 7) and not (k == "up" and i % 9 == 0) and not (k == "d" and i == 3)]
    rows.append(("b", "up", days[5], None)) if days[5] not in {r[2] for r in rows if r[1] == "up"} else None
    pnl = spark.createDataFrame(rows, "book string, point string, date date, pnl double").repartition(3)
    got = {r.point: r for r in tuning.paired_hac(pnl, "d", 4).collect()}
    for k in ("up", "down"):
        d = [x - b for i, (x, b) in enumerate(zip(s[k], s["d"])) if i != 3 and not (k == "up" and i % 9 == 0)]
        mean, t = hac(d, 4)
        assert got[k].n == len(d) and got[k].mean == pytest.approx(mean) and got[k].tstat == pytest.approx(t) and got[k].p_value == pytest.approx(math.erfc(abs(t) / math.sqrt(2)), rel=1e-6)
    assert (got["same"].mean, got["same"].tstat, got["same"].p_value) == (0.0, None, None)
    assert (got["short"].n, got["short"].mean, got["short"].p_value) == (6, None, None)
    assert (got["d"].n, got["d"].mean, got["d"].p_value) == (0, 0.0, 1.0)


def test_report_leaves_out_books_without_the_default(spark):
    days, s = streams(np.random.default_rng(5))
    rows = [(b, k, d, float(x)) for b in "ab" for k, v in s.items() for d, x in zip(days, v) if not (b == "b" and k == "d")]
    r = tuning.grid_report(spark.createDataFrame(rows, "book string, point string, date date, pnl double"), "d", "2024-01-10", "2024-02-15", 3, 252).collect()
    assert {x.book for x in r} == {"a"} and {x.point: x.improves for x in r}["up"] and not {x.point: x.improves for x in r}["d"]


def test_candidates_and_adoption(spark):
    rows = [("a", "p1", 0.01, True), ("a", "p2", 0.001, False), ("a", "p3", None, True), ("a", "d", 1.0, False), ("b", "p1", 0.5, False), ("b", "d", 1.0, False), ("c", "p1", 0.002, True), ("c", "d", 1.0, False)]
    rep = spark.createDataFrame(rows, "book string, point string, p_value double, improves boolean")
    c = {r.book: r for r in tuning.candidates(rep, 10).collect()}
    assert (c["a"].point, c["a"].p_bonferroni, c["a"].found) == ("p1", pytest.approx(0.1), True)
    assert (c["b"].point, c["b"].p_bonferroni, c["b"].found) == (None, 1.0, False)
    assert {r.book: r.p_bonferroni for r in tuning.candidates(rep).collect()}["a"] == pytest.approx(0.04)
    a = {r.book: (round(r.p_fdr, 9), r.adopt) for r in tuning.adopted(tuning.candidates(rep, 10), 0.07).collect()}
    assert a == {"a": (0.15, False), "b": (1.0, False), "c": (0.06, True)}


def test_winner_per_key_has_a_default(spark):
    t = spark.createDataFrame([("x", "s1", 1.0), ("x", "s2", 2.0), ("y", "s1", None), ("y", "s2", float("nan")), ("z", "s1", 3.0), ("z", "s2", 3.0)], "k string, spec string, v double")
    every = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "k string")
    got = {r.k: (r.winner, r.v) for r in tuning.winner_per_key(t, "k", "spec", "v", "s1", every).collect()}
    assert got == {"x": ("s2", 2.0), "y": ("s1", None), "z": ("s2", 3.0), "w": ("s1", None)}
    assert {r.k for r in tuning.winner_per_key(t, "k", "spec", "v", "s1").collect()} == {"x", "y", "z"}


def test_month_end_rebalances_are_the_last_panel_dates(spark):
    p = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 26),), (dt.date(2024, 2, 2),), (dt.date(2024, 2, 2),)], "date date")
    assert sorted(r.date.day for r in tuning.rebalance_dates(p, "monthly").collect()) == [2, 26]
    assert tuning.rebalance_dates(p, "weekly").count() == 3


D1, D2 = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
UNDEF = 9_223_372_036_854_775_807


def test_whole_transform_counts_every_row_once(spark):
    bar = "date date, instrument_id long, open long, high long, low long, close long, volume long, asset string, root string, exchange string"
    p = 5_000_000_000

    def b(day, i, asset, o=p, h=p, l=p, c=p, v=10):
        return (day, i, o, h, l, c, v, asset, asset, "X")

    bars = [b(D1, 1, "AA"), b(D2, 1, "AA", h=4_000_000_000), b(D2, 1, "AA", v=0), b(D1, 2, "AA"), b(D1, 3, "AA", o=UNDEF), b(D1, 9, "AA"), b(D1, 4, "AA"), b(D1, 5, "AA"), b(D1, 6, "AA", l=0), b(D1, 7, "AA"),
            b(D1, 11, "BB"), b(D1, 12, "BB"), b(D1, 13, "BB", c=-p), b(D1, 21, "CC")]
    df = "date date, arrival long, instrument_id long, instrument_class string, maturity_year int, maturity_month int, raw_symbol string"
    defs = [(D1, 1, 1, "F", 2024, 3, "AAH4"), (D1, 1, 2, "S", 2024, 3, "H4-M4"), (D1, 1, 3, "F", 2024, 3, "AAH4"), (D1, 1, 4, "S", 2024, 3, "UD:1N: H4"), (D1, 1, 5, "X", 2024, 3, "AAX"), (D1, 1, 6, "F", 2024, 3, "AAH4"),
            (D1, 1, 7, "S", None, 3, "H4-M4"), (D1, 1, 11, "S", 2024, 3, "H4-M4"), (D1, 1, 12, "F", 2024, 3, "BBH4_Z"), (D1, 1, 13, "F", 2024, 3, "BBH4"), (D1, 1, 21, "F", 2024, 3, "CCH4")]
    roots = spark.createDataFrame([("AA", "X"), ("BB", "X"), ("CC", "X"), ("DD", "X")], "leg_root string, leg_exchange string")
    tables, seen = combos.transform(spark.createDataFrame(bars, bar), spark.createDataFrame(defs, df), roots, F.col("root") == "BB")
    m = {r.asset: r for r in tables["manifest"].collect()}
    a = m["AA"]
    assert (a.rows_read, a.join_unmatched_rows, a.other_instrument_class_rows, a.outright_rows, a.spread_rows, a.zero_volume_outright_rows, a.ohlc_violation_rows) == (10, 1, 1, 3, 1, 1, 1)
    assert a.status == "PARTIAL" and a.detail == "sentinel_price_rows_dropped=1; outright_incomplete_price_rows_dropped=1; user_defined_spreads=1; spread_incomplete_key=1"
    assert (m["BB"].status, m["BB"].spread_rows, m["BB"].non_positive_price_rows) == ("PARTIAL", 0, 1)
    assert m["BB"].detail == "ice_outright_Z_variant_excluded=1; ICE_schema_unsupported_spreads=1"
    assert (m["CC"].status, m["CC"].detail) == ("OK", None) and (m["DD"].status, m["DD"].rows_read) == ("NO_RAW_DATA", 0)
    assert seen["rows_read"] == 14 and sum(seen[t] for t in combos.TARGETS) == 14 and seen["outright"] == tables["term_structure"].count() == 5
    s = tables["spread"].collect()
    assert [(r.asset, r.near_contract_symbol, r.far_contract_symbol, r.close) for r in s] == [("AA", "AAH24.X", "AAM24.X", 5.0)]
    assert {(r.asset, r.reject_reason): r.row_count for r in tables["rejects"].collect()} == {("AA", "user_defined"): 1, ("AA", "incomplete_key"): 1, ("BB", "venue_unsupported"): 1}


def test_stale_gaps_are_counted_and_reports_compared(spark):
    from termflow.operators import book
    month_ends = [dt.date(2015, m, 28) for m in range(1, 13)] + [dt.date(2016, m, 28) for m in (1, 6, 7)]
    reb = spark.createDataFrame([("b", d) for d in month_ends] + [("c", dt.date(2015, 1, 28))], "book string, date date")
    assert {(r.book, r.n_dates, r.n_stale_gaps) for r in book.stale_gaps(reb).collect()} == {("b", 15, 1), ("c", 1, 0)}
    rows = None
    for run, v in (("2024-01-05", [("b", 1.0, 10)]), ("2024-01-12", [("b", 1.5, 11), ("new", 2.0, 3)]), ("2024-01-19", [("b", None, 12)])):
        x = book.report_rows(spark.createDataFrame(v, "book string, sharpe double, n int"), ["book"], run)
        rows = x if rows is None else rows.unionByName(x)
    got = {(r.run, r.book, r.metric): (r.prior_run, r.prior_value, r.delta) for r in book.against_prior(rows, ["book"]).collect()}
    assert got["2024-01-05", "b", "sharpe"] == (None, None, None)
    assert got["2024-01-12", "b", "sharpe"] == ("2024-01-05", 1.0, 0.5) and got["2024-01-12", "new", "n"] == ("2024-01-05", None, None)
    assert got["2024-01-19", "b", "sharpe"] == ("2024-01-12", 1.5, None) and got["2024-01-19", "b", "n"] == ("2024-01-12", 11.0, 1.0)


def test_known_expiries_take_the_last_listed_date_before(spark):
    from termflow.operators import curve
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(0, 40, 2)]
    rows = [("a", d, s, 2024, c, 10.0, 5.0 if s == "H" else 1.0) for d in days for s, c in (("H", "H"), ("M", "M"))]
    c = spark.createDataFrame(rows, "asset string, date date, contract_symbol string, expiry_year int, expiry_code string, close double, volume double")
    ex = spark.createDataFrame([("a", "H", dt.date(2024, 1, 22)), ("a", "M", dt.date(2024, 12, 1))], "asset string, contract_symbol string, expiry_date date")
    got = {r.date: r.front_contract_symbol for r in curve.assign_front(c, 2, 3, expiry=ex).collect()}
    # the expiry falls between the listed days 21 and 23: the roll comes three rows before the 21st
    assert got[dt.date(2024, 1, 13)] == "H" and got[dt.date(2024, 1, 15)] == "M"
