"""The volatility fit recovers parameters anywhere, not inside a box."""
import numpy as np
import pytest

from termflow.operators import garch


def simulate(a, g, b, n=6000, seed=4):
    z, r, s2 = np.random.default_rng(seed).standard_normal(n), np.zeros(n), 1.0
    omega = 1 - a - b - g / 2
    for t in range(n):
        if t:
            s2 = omega + (a + (g if r[t - 1] < 0 else 0)) * r[t - 1] ** 2 + b * s2
        r[t] = np.sqrt(s2) * z[t]
    return r


@pytest.mark.parametrize("a, g, b", [(0.3, 0.0, 0.2), (0.5, 0.0, 0.05), (0.05, 0.1, 0.85)])
def test_fit_recovers_parameters(a, g, b):
    (fa, fg, fb, _), done = garch.fit_checked(simulate(a, g, b))
    assert done and abs(fa - a) < 0.07 and abs(fg - g) < 0.07 and abs(fb - b) < 0.08


def test_search_says_when_it_did_not_close_in():
    p, done = garch.pattern_search(lambda x: -x[0], [0.0], [1.0], lambda x: x[0] < 1e9, rounds=5)
    assert not done and p[0] == 5


def test_walk_forward_rows_and_values(spark):
    import datetime as dt

    from pyspark.sql import functions as F
    r = simulate(0.1, 0.1, 0.7, 130, 3)
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(r)] + [("b", dt.date(2020, 1, 1), 0.1), ("c", dt.date(2020, 1, 1), None)]
    got = garch.walk_forward_vol(spark.createDataFrame(rows, "asset string, date date, ret double"), "ret", 100, 20, 252).orderBy("date").collect()
    assert len(got) == 30 and {x.asset for x in got} == {"a"} and {x.fit_status for x in got} <= {"converged", "not converged"}
    p, _ = garch.fit_checked(r[:100])
    assert [x.garch_vol for x in got[:20]] == pytest.approx((garch.sigmas(r[:120], p)[100:] * 252 ** 0.5).tolist())
