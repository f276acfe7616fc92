"""Path-dependent recursions as keyed folds over calendar-bounded series."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from termflow.functions.cols import seq


def ewma_vol(panel: DataFrame, ret: str, com: float = 60, ppy: int = 252, key: str = "asset", out: str = "ewma_vol") -> DataFrame:
    """Recursive squared-return average; gaps decay the old weight, empty rows repeat the value."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        v = (pdf["r"] ** 2).ewm(com=com, adjust=False).mean()
        return pd.DataFrame({key: pdf[key], "date": pdf["date"], out: np.sqrt(v * ppy)}).replace({np.nan: None})
    return panel.select(key, "date", F.col(ret).alias("r")).groupBy(key).applyInPandas(fold, f"{key} string, date date, {out} double")


def donchian_states(channels: DataFrame, systems: list[tuple[int, int]], close: str = "close", key: str = "asset") -> DataFrame:
    """(key, date, system, state): entry on the long channel, exit on the short one, one step per row.

    A missing price or entry channel emits a missing state and keeps the position.
    """
    specs = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("system"), F.col(f"hi_{a}").alias("eh"), F.col(f"lo_{a}").alias("el"),
                               F.col(f"hi_{b}").alias("xh"), F.col(f"lo_{b}").alias("xl")) for a, b in systems])
    x = channels.select(key, "date", F.col(close).alias("p"), F.explode(specs).alias("s")).select(key, "date", "p", "s.*")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        st, out = 0.0, []
        for p, eh, el, xh, xl in zip(pdf.p, pdf.eh, pdf.el, pdf.xh, pdf.xl):
            if pd.isna(p) or pd.isna(eh) or pd.isna(el):
                out.append(None)
                continue
            if st == 0:
                st = 1.0 if p > eh else -1.0 if p < el else 0.0
            elif (st > 0 and p < xl) or (st < 0 and p > xh):
                st = 0.0
            out.append(st)
        return pd.DataFrame({key: pdf[key], "date": pdf["date"], "system": pdf["system"], "state": out})

    return x.groupBy(key, "system").applyInPandas(fold, f"{key} string, date date, system string, state double")


def kalman_hedge(pairs: DataFrame, y: str, x: str, delta: float = 1e-4, ve: float = 1e-3, warmup: int = 60, key: str = "pair") -> DataFrame:
    """(pair, date, alpha, beta): random-walk regression coefficients over jointly observed rows."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        th, P, V = np.zeros(2), np.zeros((2, 2)), delta / (1 - delta) * np.eye(2)
        out = []
        for k, (b, a) in enumerate(zip(pdf["y"], pdf["x"])):
            H = np.array([1.0, a])
            P = P + V
            K = P @ H / (H @ P @ H + ve)
            th = th + K * (b - H @ th)
            P = P - np.outer(K, H) @ P
            out.append((None, None) if k < warmup else (th[0], th[1]))
        return pd.DataFrame({key: pdf[key], "date": pdf["date"], "alpha": [o[0] for o in out], "beta": [o[1] for o in out]})

    j = pairs.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(key, "date", F.col(y).alias("y"), F.col(x).alias("x"))
    return j.groupBy(key).applyInPandas(fold, f"{key} string, date date, alpha double, beta double")


# MacKinnon response surface for a two-series residual test with a constant.
TAU_STAR, TAU_MIN, TAU_MAX = -2.62, -18.86, 0.92
TAU_SMALL = (2.92, 1.5012, 0.039796)
TAU_LARGE = (2.1945, 0.64695, -0.29198, -0.042377)


def tau_pvalue(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    z = sum(c * tau ** i for i, c in enumerate(TAU_SMALL if tau <= TAU_STAR else TAU_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def unit_root_tau(e: np.ndarray, lags: int | None = None) -> float:
    """Augmented Dickey-Fuller statistic without constant; lag count by AIC on a common sample unless given."""
    d = np.diff(e)
    n = len(e)
    top = max(0, min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 1))

    def regress(lags: int, first: int):
        yv = d[first:]
        X = np.column_stack([e[first:-1]] + [d[first - k:len(d) - k] for k in range(1, lags + 1)])
        beta, *_ = np.linalg.lstsq(X, yv, rcond=None)
        res = yv - X @ beta
        return X, beta, res, len(yv)

    def aic(lags: int) -> float:
        X, _, res, m = regress(lags, top)
        return m * (math.log(2 * math.pi) + math.log(res @ res / m) + 1) + 2 * X.shape[1]

    best = min(range(top + 1), key=aic) if lags is None else lags
    X, beta, res, m = regress(best, best)
    s2 = res @ res / (m - X.shape[1])
    return float(beta[0] / math.sqrt(s2 * np.linalg.inv(X.T @ X)[0, 0]))


def engle_granger(pairs: DataFrame, y: str, x: str, window: int = 252, step: int = 21, key: str = "pair", lags: int | None = None) -> DataFrame:
    """(pair, date, stat, pvalue) for every step-th trailing window of jointly observed rows.

    Each row joins the at most ceil(window/step) windows that hold it; every (pair, window) is then an
    independent group of `window` rows.
    """
    j = pairs.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(key, "date", F.col(y).alias("y"), F.col(x).alias("x"))
    j = j.withColumn("rn", F.row_number().over(seq(key)))
    n = j.groupBy(key).agg(F.max("rn").alias("n"))
    first = F.greatest(F.ceil((F.col("rn") - window) / step), F.lit(0))
    last = F.least(F.floor((F.col("rn") - 1) / step), F.floor((F.col("n") - window) / step))
    w = j.join(n, key).where((F.col("n") >= window) & (first <= last)).select(key, "date", "rn", "y", "x", F.explode(F.sequence(first, last)).alias("win"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        yv = pdf["y"].to_numpy()
        X = np.column_stack([pdf["x"].to_numpy(), np.ones(len(pdf))])
        try:
            beta, *_ = np.linalg.lstsq(X, yv, rcond=None)
            tau = unit_root_tau(yv - X @ beta, lags)
        except Exception:  # an unsolvable window is skipped
            return pd.DataFrame(columns=[key, "date", "stat", "pvalue"], dtype=object)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "date": [pdf["date"].iloc[-1]], "stat": [tau], "pvalue": [tau_pvalue(tau)]})

    return w.groupBy(key, "win").applyInPandas(test, f"{key} string, date date, stat double, pvalue double")


def cointegration_report(tests: DataFrame, registry: DataFrame, alpha: float = 0.05, key: str = "pair") -> DataFrame:
    """Tested windows and rejection share per registered pair; pairs without data stay with none."""
    g = tests.groupBy(key).agg(F.count(F.lit(1)).alias("n_windows"), F.avg((F.col("pvalue") < alpha).cast("double")).alias("fraction"))
    return registry.join(g, key, "left").select(*registry.columns, F.coalesce("n_windows", F.lit(0)).alias("n_windows"), "fraction")
