"""GJR-GARCH(1,1,1) helpers used inside keyed tasks: zero mean, Gaussian likelihood, variance targeting."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from termflow.session import spread


def variance_path(r: np.ndarray, a, g, b, long_run: float) -> np.ndarray:
    """Conditional variances for one or many parameter sets at once (last axis)."""
    a, g, b = (np.asarray(x, dtype=float) for x in (a, g, b))
    omega = long_run * (1 - a - b - g / 2)
    shock, wide = r * r, (slice(None), *[None] * a.ndim)
    s2 = np.empty((len(r), *a.shape))
    s2[0] = long_run
    s2[1:] = omega + (a + g * (r[:-1] < 0)[wide]) * shock[:-1][wide]  # all but the last variance's share, which the loop adds
    for t in range(1, len(r)):
        s2[t] += b * s2[t - 1]
    return s2


def pattern_search(loss, start, step, inside, least: float = 5e-4, rounds: int = 80) -> tuple[np.ndarray, bool]:
    """Least loss over the points that `inside` allows, and whether the search closed in on it.

    Each round tries a grid of five points an axis around the best point, all candidates at once; the grid moves on while
    its edge is best and shrinks otherwise, so no box bounds the result.
    """
    best, step = np.asarray(start, float), np.asarray(step, float)
    for _ in range(rounds):
        grid = np.stack(np.meshgrid(*[m + h * np.array([0.0, -0.5, 0.5, -1.0, 1.0]) for m, h in zip(best, step)], indexing="ij")).reshape(len(best), -1)
        grid = grid[:, inside(grid)]
        new = grid[:, int(np.argmin(loss(grid)))]
        edge = (np.abs(new - best) > 0.75 * step).any()
        best = new
        if not edge:
            step = step * 0.4
            if step.max() < least:
                return best, True
    return best, False


def fit_checked(r: np.ndarray) -> tuple[tuple[float, float, float, float], bool]:
    """(a, g, b, long-run variance) of the largest likelihood, and whether the search converged; several starts."""
    lr = float(np.mean(r * r))
    ok = lambda p: (p[0] >= 0) & (p[2] >= 0) & (p[0] + p[1] >= 0) & (p[0] + p[2] + p[1] / 2 < 0.9995)

    def nll(p):
        s2 = variance_path(r, *p, lr)
        return np.sum(np.log(s2) + (r * r)[:, None] / s2, axis=0)

    first = np.stack(np.meshgrid([0.02, 0.1, 0.3, 0.5], [0.0, 0.1], [0.05, 0.3, 0.6, 0.85], indexing="ij")).reshape(3, -1)
    first = first[:, ok(first)]
    p, done = pattern_search(nll, first[:, int(np.argmin(nll(first)))], (0.05, 0.05, 0.08), ok)
    return (float(p[0]), float(p[1]), float(p[2]), lr), done


def fit(r: np.ndarray) -> tuple[float, float, float, float]:
    return fit_checked(r)[0]


def sigmas(r: np.ndarray, params: tuple[float, float, float, float]) -> np.ndarray:
    a, g, b, lr = params
    return np.sqrt(variance_path(r, a, g, b, lr))


def walk_forward_vol(panel: DataFrame, ret: str, warmup: int = 500, refit: int = 20, ppy: int = 252, key: str = "asset") -> DataFrame:
    """(key, date, garch_vol): refit every `refit` observations on all earlier ones, filtered between.

    One fold per series reads its returns once. Every refit searches from the same starts: one that goes on from the last optimum
    stays in a worse one where the likelihood has several. The series are spread over all partitions, as the work is heavy and the
    rows few.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        r = pdf["r"].to_numpy(dtype=float)
        sig, status = np.full(len(r), np.nan), [None] * len(r)
        for start in range(warmup, len(r), refit):
            end = min(start + refit, len(r))
            try:
                p, ok = fit_checked(r[:start])
                said = "converged" if ok else "not converged"
                sig[start:end] = sigmas(r[:end], p)[start:]
            except (ValueError, FloatingPointError) as e:  # the block stays empty and says why
                said = f"failed: {e}"
            status[start:end] = [said] * (end - start)
        out = pd.DataFrame({key: pdf[key], "date": pdf["date"], "garch_vol": sig * math.sqrt(ppy), "fit_status": status})
        return out.iloc[warmup:].replace({np.nan: None})

    s = spread(panel.where(F.col(ret).isNotNull()).select(key, "date", F.col(ret).alias("r")), key)
    return s.groupBy(key).applyInPandas(fold, f"{key} string, date date, garch_vol double, fit_status string")


def filtered_vol(panel: DataFrame, ret: str, params: tuple[float, float, float], warmup: int = 500, ppy: int = 252, key: str = "asset") -> DataFrame:
    """(key, date, garch_vol) of given parameters: the long-run variance is that of the first `warmup` returns, rows after them are given."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        r = pdf["r"].to_numpy(dtype=float)
        sig = sigmas(r, (*params, float(np.mean(r[:warmup] ** 2)))) if len(r) > warmup else r
        return pd.DataFrame({key: pdf[key], "date": pdf["date"], "garch_vol": sig * math.sqrt(ppy)}).iloc[warmup:]

    s = spread(panel.where(F.col(ret).isNotNull()).select(key, "date", F.col(ret).alias("r")), key)
    return s.groupBy(key).applyInPandas(fold, f"{key} string, date date, garch_vol double")


def dcc_path(streams: DataFrame, x: str = "pnl", key: str = "set_id", volatility: tuple[float, float, float] | None = None,
             dynamics: tuple[float, float] | None = None) -> DataFrame:
    """(set, date, i, j, corr, cov): dynamic conditional correlation of each stream set.

    One fold per set over complete rows: GJR variances per stream, then the two-parameter recursion
    around the unconditional correlation, its parameters picked by likelihood; `converged` tells whether that search closed in.
    Given parameters (`volatility`: a, g, b of every stream, `dynamics`: a, b of the correlation) are taken as they are.
    """
    def correlations(z, qbar, a, b):
        path, q = np.empty((len(z), *qbar.shape)), qbar
        for t in range(len(z)):
            if t:
                q = (1 - a - b) * qbar + a * np.outer(z[t - 1], z[t - 1]) + b * q
            d = np.sqrt(np.diag(q))
            path[t] = q / np.outer(d, d)
        return path

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="date", columns="stream", values=x).sort_index().dropna()
        r = m.to_numpy()
        sg = np.column_stack([sigmas(c, fit(c) if volatility is None else (*volatility, float(np.mean(c * c)))) for c in r.T])
        z = r / sg
        qbar = np.corrcoef(z.T)

        def nll(grid):
            out = []
            for a, b in grid.T:
                c = correlations(z, qbar, a, b)
                out.append(np.linalg.slogdet(c)[1].sum() + (z[:, None, :] @ np.linalg.solve(c, z[:, :, None])).sum())
            return np.array(out)

        ok = lambda p: (p[0] >= 0) & (p[1] >= 0) & (p[0] + p[1] < 0.9995)
        first = np.array([(a, b) for a in (0.01, 0.04, 0.1) for b in (0.3, 0.7, 0.88)]).T
        p, converged = (dynamics, True) if dynamics else pattern_search(nll, first[:, int(np.argmin(nll(first)))], (0.02, 0.06), ok, 2e-3)
        best = (None, correlations(z, qbar, *p))
        rows, names = [], list(m.columns)
        for i, ni in enumerate(names):
            for j, nj in enumerate(names):
                c = best[1][:, i, j]
                rows.append(pd.DataFrame({key: pdf[key].iloc[0], "date": m.index, "i": ni, "j": nj, "corr": c, "cov": c * sg[:, i] * sg[:, j], "converged": converged}))
        return pd.concat(rows)

    return spread(streams.select(key, "stream", "date", x), key).groupBy(key).applyInPandas(fold, f"{key} string, date date, i string, j string, corr double, cov double, converged boolean")
