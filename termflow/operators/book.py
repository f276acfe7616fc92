"""Risk-targeted books: many (book, point) walks in parallel, everything around them in SQL operators."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termflow.functions.cols import seq
from termflow.session import spread

# Default book parameters.
DEFAULTS = dict(gamma=20000.0, kappa=1.0, lambd=0.0, max_weight=0.30, target_vol=0.10, ppy=52.0, halflife=87.0,
                scale_min=0.1, scale_max=5.0, neutral=False, garch=False)
MIN_DATES, MAX_GAP_DAYS, GARCH_WARMUP, GARCH_REFIT = 20, 60, 104, 20


def grid(df: DataFrame, points: list[dict], book: str = "book") -> DataFrame:
    """Each book with each parameter point: a short literal array exploded, no join."""
    full = [{**DEFAULTS, **p} for p in points]
    rows = F.array(*[F.struct(F.lit(p.get("point", str(i))).alias("point"), *[F.lit(p[k]).alias(k) for k in DEFAULTS]) for i, p in enumerate(full)])
    return df.select(book).distinct().select(book, F.explode(rows).alias("p")).select(book, "p.*")


def period_returns(panel: DataFrame, rebalances: DataFrame, ret: str = "ret", by=("book",)) -> DataFrame:
    """(book, date, asset, pr): summed returns in (date, next date]; gaps over 60 days earn zero.

    rebalances(book, date). Panel dates find their rebalance on the calendar, then join by equality.
    """
    d = rebalances.withColumn("next", F.lead("date").over(W.partitionBy(*by).orderBy("date")))
    cal = panel.select(F.col("date").alias("d")).distinct()
    books = rebalances.select(*by).distinct()
    grid_ = books.select(*by, F.explode(cal.agg(F.array_sort(F.collect_set("d")).alias("c")).scalar()).alias("d"))
    marks = d.select(*by, F.col("date").alias("d"), F.col("date").alias("__reb"), "next")
    w = W.partitionBy(*by).orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    own = grid_.join(marks, [*by, "d"], "left").select(*by, "d", F.last("__reb", True).over(w).alias("date"), F.last("next", True).over(w).alias("next"))
    own = own.where("date is not null and d <= next")
    x = own.join(panel.select("asset", F.col("date").alias("d"), F.col(ret).alias("r")), "d")
    return x.groupBy(*by, "date", "next", "asset").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("s")).select(
        *by, "date", "asset", F.when(F.datediff("next", "date") > MAX_GAP_DAYS, 0.0).otherwise(F.col("s")).alias("pr"))


def stale_gaps(rebalances: DataFrame, by=("book",), max_gap: int = MAX_GAP_DAYS) -> DataFrame:
    """(book, n_dates, n_stale_gaps): rebalance dates, and how many wait longer than max_gap days for the next one and so earn nothing."""
    d = rebalances.select(*by, "date").distinct().withColumn("next", F.lead("date").over(W.partitionBy(*by).orderBy("date")))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_dates"), F.count(F.when(F.datediff("next", "date") > max_gap, 1)).alias("n_stale_gaps"))


def book_inputs(alpha: DataFrame, cov: DataFrame, panel: DataFrame, ret: str = "ret") -> DataFrame:
    """(book, date, assets, a, s, pr): one row of aligned arrays per book and rebalance date.

    alpha(book, asset, date, alpha); cov(rebalance_date, i, j, cov). A date with any missing alpha or
    covariance cell is left out.
    """
    uni = alpha.groupBy("book").agg(F.array_sort(F.collect_set("asset")).alias("assets"))
    n = F.size("assets")
    a = alpha.where("alpha is not null").groupBy("book", "date").agg(F.array_sort(F.collect_list(F.struct("asset", "alpha"))).alias("v"))
    a = a.join(uni, "book").where(F.size("v") == n).select("book", "date", "assets", F.col("v.alpha").alias("a"))
    mine = a.select("book", "assets").distinct().select("book", F.explode("assets").alias("asset"))
    c = cov.where("cov is not null").join(mine.select("book", F.col("asset").alias("i")), "i").join(mine.select("book", F.col("asset").alias("j")), ["book", "j"])
    c = c.groupBy("book", F.col("rebalance_date").alias("date")).agg(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))).alias("m"))
    x = a.join(c, ["book", "date"]).where(F.size("m") == n * n).select("book", "date", "assets", "a", F.col("m.cov").alias("s"))
    x = x.join(panel.select("date").distinct(), "date", "left_semi")
    pr = period_returns(panel, x.select("book", "date"), ret).join(mine, ["book", "asset"], "left_semi")
    pr = pr.groupBy("book", "date").agg(F.array_sort(F.collect_list(F.struct("asset", "pr"))).alias("p"))
    x = x.join(pr, ["book", "date"], "left").withColumn("pr", F.col("p.pr")).drop("p")
    return x.withColumn("n_dates", F.count(F.lit(1)).over(W.partitionBy("book"))).where(F.col("n_dates") >= MIN_DATES).drop("n_dates")


def solve_step(a, sigma, prev, p) -> np.ndarray:
    """One inertia mean-variance solve, recentered when neutral, clipped to the weight limit."""
    lhs = p["gamma"] * sigma + p["kappa"] * np.eye(len(a))
    x = np.linalg.solve(lhs, a + p["kappa"] * prev - p["lambd"] * np.sign(prev))
    if p["neutral"]:
        x = x - x.mean()
    return np.clip(x, -p["max_weight"], p["max_weight"])


def target_step(x, var, p) -> tuple[np.ndarray, float, bool]:
    """Scale toward the volatility target, no further than the weight limit allows."""
    rv = math.sqrt(max(var, 0.0) * p["ppy"])
    scale, bound = 1.0, False
    if rv > 1e-8:
        want = (p["target_vol"] / rv) ** 2
        top = np.abs(x).max()
        cap = p["max_weight"] / top if top > 0 else math.inf
        bound = cap < want
        scale = float(np.clip(min(want, cap), p["scale_min"], p["scale_max"]))
    return x * scale, scale, bound


def limit_step(x, p) -> np.ndarray:
    x = np.clip(x, -p["max_weight"], p["max_weight"])
    return x - x.mean() if p["neutral"] else x


def run_books(inputs: DataFrame, points: DataFrame, solve=solve_step, target=target_step, limit=limit_step) -> DataFrame:
    """(book, point, date, asset, w, scale, cap_bound): one sequential walk per (book, point).

    Rows per group are rebalance dates, so a walk is bounded by the calendar; books and points run in
    parallel. The step functions may be replaced.
    """
    names = list(DEFAULTS)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        from termflow.operators.garch import fit, sigmas
        pdf = pdf.sort_values("date")
        p = {k: pdf[k].iloc[0] for k in names}
        n = len(pdf["a"].iloc[0])
        decay = 1 - math.exp(-math.log(2.0) / p["halflife"])
        var, prev, back, hist, par, at = p["target_vol"] ** 2 / p["ppy"], np.zeros(n), None, [], None, 0
        out = []
        for a, s, pr in zip(pdf["a"], pdf["s"], pdf["pr"]):
            if back is not None:
                got = float(prev @ back)
                var = (1 - decay) * var + decay * got * got
                hist.append(got)
            now = var
            if p["garch"] and len(hist) >= GARCH_WARMUP:
                h = np.asarray(hist)
                if par is None or len(h) - at >= GARCH_REFIT:
                    par, at = fit(h), len(h)
                now = float(sigmas(h, par)[-1]) ** 2
            x, scale, bound = target(solve(np.asarray(a), np.asarray(s).reshape(n, n), prev, p), now, p)
            prev = limit(x, p)
            back = None if pr is None else np.asarray(pr, dtype=float)
            out.append((prev.tolist(), scale, bound))
        return pd.DataFrame({"book": pdf["book"], "point": pdf["point"], "date": pdf["date"], "assets": pdf["assets"],
                             "w": [o[0] for o in out], "scale": [o[1] for o in out], "cap_bound": [o[2] for o in out]})

    x = spread(inputs.join(points, "book"), "book", "point").groupBy("book", "point").applyInPandas(
        walk, "book string, point string, date date, assets array<string>, w array<double>, scale double, cap_bound boolean")
    return x.select("book", "point", "date", "scale", "cap_bound", F.explode(F.arrays_zip("assets", "w")).alias("z")).select(
        "book", "point", "date", F.col("z.assets").alias("asset"), F.col("z.w").alias("w"), "scale", "cap_bound")


def contributions(weights: DataFrame, period: DataFrame) -> DataFrame:
    """(…, asset, w, contribution): weight times the following period's return; the last date earns none."""
    return weights.join(period, ["book", "date", "asset"]).withColumn("contribution", F.col("w") * F.col("pr"))


def book_pnl(weights: DataFrame, period: DataFrame, points: DataFrame | None = None, cost_bps: DataFrame | None = None) -> DataFrame:
    """(book, point, date, gross, turnover, penalty, cost, pnl)."""
    c = contributions(weights, period)
    c = c.withColumn("t", F.abs(F.col("w") - F.lag("w").over(seq(("book", "point", "asset")))))
    c = c.join(cost_bps, "asset", "left") if cost_bps is not None else c.withColumn("cost_bps", F.lit(0.0))
    g = c.groupBy("book", "point", "date").agg(
        F.sum("contribution").alias("gross"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("turnover"),
        F.coalesce(F.sum(F.col("t") * F.coalesce("cost_bps", F.lit(0.0)) / 10_000), F.lit(0.0)).alias("cost"))
    if points is None:
        g = g.withColumn("lambd", F.lit(0.0))
    else:
        g = g.join(points.select("book", "point", "lambd"), ["book", "point"])
    g = g.withColumn("penalty", F.col("lambd") * F.col("turnover")).drop("lambd")
    return g.withColumn("pnl", F.col("gross") - F.col("penalty") - F.col("cost"))


def daily_mark(weights: DataFrame, panel: DataFrame, ret: str = "ret", cost_bps: DataFrame | None = None, by=("book", "point")) -> DataFrame:
    """Panel-date marks of a weight path: weights carried forward, lagged one row, rebalance cost on its date."""
    k = [*by, "asset"]
    cal = panel.agg(F.array_sort(F.collect_set("date")).alias("c"))
    g = weights.select(*k).distinct().select(*k, F.explode(cal.scalar()).alias("date"))
    g = g.join(weights.select(*k, "date", "w"), [*k, "date"], "left")
    w0 = seq(tuple(k))
    held = F.last("w", True).over(w0.rowsBetween(W.unboundedPreceding, 0))
    g = g.withColumn("h", held).withColumn("h", F.lag("h").over(w0))
    x = g.join(panel.select("asset", "date", F.col(ret).alias("r")), ["asset", "date"], "left")
    gross = x.groupBy(*by, "date").agg(F.coalesce(F.sum(F.col("h") * F.col("r")), F.lit(0.0)).alias("pnl"))
    if cost_bps is None:
        return gross
    t = weights.withColumn("t", F.abs(F.col("w") - F.lag("w").over(w0))).join(cost_bps, "asset", "left")
    c = t.groupBy(*by, "date").agg(F.sum(F.col("t") * F.coalesce("cost_bps", F.lit(0.0)) / 10_000).alias("c"))
    return gross.join(c, [*by, "date"], "left").select(*by, "date", (F.col("pnl") - F.coalesce("c", F.lit(0.0))).alias("pnl"))


def allocate(pnl: DataFrame, weights: dict[str, float] | None = None, x: str = "pnl", by=("date",)) -> DataFrame:
    """Weighted sum of the active books' streams; a book absent on a date adds nothing."""
    w: Column = F.lit(1.0)
    for b, v in (weights or {}).items():
        w = F.when(F.col("book") == b, v).otherwise(w)
    return pnl.groupBy(*by).agg(F.sum(w * F.col(x)).alias(x))


def attribution(contrib: DataFrame, by: list[str], cumulative: bool = True) -> DataFrame:
    g = contrib.groupBy(*by, "date").agg(F.sum("contribution").alias("contribution"))
    if not cumulative:
        return g.groupBy(*by).agg(F.sum("contribution").alias("total"))
    return g.withColumn("cumulative", F.sum("contribution").over(W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)))


def net_by_sector(contrib: DataFrame, cost_bps: DataFrame) -> DataFrame:
    """Exact net decomposition by sector: contributions minus each asset's own cost."""
    t = contrib.withColumn("t", F.abs(F.col("w") - F.lag("w").over(seq(("book", "point", "asset"))))).join(cost_bps, "asset", "left")
    c = F.coalesce(F.col("t") * F.col("cost_bps") / 10_000, F.lit(0.0))
    return t.groupBy("book", "point", "sector", "date").agg(F.sum(F.col("contribution") - c).alias("net"))


def reconcile(sector_net: DataFrame, pnl: DataFrame) -> DataFrame:
    """Largest absolute difference between the sector sum and the book's own net series."""
    s = sector_net.groupBy("book", "point", "date").agg(F.sum("net").alias("s"))
    j = s.join(pnl, ["book", "point", "date"])
    return j.groupBy("book", "point").agg(F.max(F.abs(F.col("s") - (F.col("gross") - F.col("cost")))).alias("max_gap"))


def report_rows(stats: DataFrame, by: list[str], run: str) -> DataFrame:
    """(run, by, metric, value): one row per figure of a report."""
    metrics = [c for c in stats.columns if c not in by]
    return stats.select(*by, *[F.col(c).cast("double").alias(c) for c in metrics]).unpivot(by, metrics, "metric", "value").withColumn("run", F.lit(run))


def against_prior(reports: DataFrame, by: list[str]) -> DataFrame:
    """Every figure of every report with that of the report before it (by run label) and the difference; NULL where there was none."""
    runs = reports.select("run").distinct().withColumn("prior_run", F.lag("run").over(W.partitionBy(F.lit(0)).orderBy("run")))
    old = reports.select(*by, "metric", F.col("run").alias("prior_run"), F.col("value").alias("prior_value"))
    j = reports.join(runs, "run").join(old, [*by, "metric", "prior_run"], "left")
    return j.select("run", "prior_run", *by, "metric", "value", "prior_value", (F.col("value") - F.col("prior_value")).alias("delta"))
