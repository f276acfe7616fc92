"""Positions, strategy returns, costs and performance statistics, long by spec."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termflow.functions.cols import div, gated, keys, running, seq
from termflow.operators.panel import period_last, resample_ffill, spread_to_panel


def holding_positions(panel: DataFrame, signal: str, months: int = 1, key="asset", align="label", out="held") -> DataFrame:
    """Mean of the last `months` month-end formations, carried forward."""
    per = period_last(panel, signal, "monthly", key)
    w = W.partitionBy(*keys(key)).orderBy("idx").rangeBetween(-(months - 1), 0)
    per = per.withColumn(signal, gated(F.avg(signal), signal, w, months))
    return spread_to_panel(panel, per, signal, key, align, out=out)


def resample_positions(panel: DataFrame, signal: str, freq: str, months: int = 1, key="asset", out="held") -> DataFrame:
    if freq == "monthly":
        return holding_positions(panel, signal, months, key, out=out)
    return resample_ffill(panel, signal, freq, key, out=out)


def positions(panel: DataFrame, signal: str, freq: str = "daily", months: int = 1, key="asset",
              by: tuple[str, ...] = ("date",), out: str = "pos") -> DataFrame:
    """Lag one row, then scale to unit gross exposure per date; missing is zero."""
    x = resample_positions(panel, signal, freq, months, key, out="__h")
    x = x.withColumn("__p", F.lag("__h").over(seq(key)))
    g = F.sum(F.abs("__p")).over(W.partitionBy(*by))
    return x.withColumn(out, F.coalesce(div("__p", g), F.lit(0.0))).drop("__h", "__p")


def turnover(x: str = "pos", key="asset") -> Column:
    """|change in position|; the first row has none, so the initial build is not charged."""
    return F.abs(F.col(x) - F.lag(x).over(seq(key)))


def backtest(pos: DataFrame, x: str = "pos", ret: str = "ret", by: tuple[str, ...] = ("date",),
             cost_bps: DataFrame | None = None, key="asset", out: str = "pnl") -> DataFrame:
    """Pooled return per date; cost_bps(asset, cost_bps) nets turnover cost."""
    gross = F.coalesce(F.sum(F.col(x) * F.col(ret)), F.lit(0.0))
    if cost_bps is None:
        return pos.groupBy(*by).agg(gross.alias(out))
    t = pos.withColumn("__t", turnover(x, key)).join(cost_bps, "asset", "left")
    drag = F.coalesce(F.sum(F.col("__t") * F.col("cost_bps") / 10_000), F.lit(0.0))
    return t.groupBy(*by).agg((gross - drag).alias(out))


def backtest_per_asset(panel: DataFrame, signal: str, ret: str = "ret", freq="daily", months=1, key="asset", out="pnl") -> DataFrame:
    x = resample_positions(panel, signal, freq, months, key, out="__h")
    return x.withColumn(out, F.lag("__h").over(seq(key)) * F.col(ret)).drop("__h")


def cost_drag(pos: DataFrame, cost_bps: DataFrame, by=("date",), key="asset") -> DataFrame:
    t = pos.withColumn("__t", turnover("pos", key)).join(cost_bps, "asset", "left")
    return t.groupBy(*by).agg(F.coalesce(F.sum(F.col("__t") * F.col("cost_bps") / 10_000), F.lit(0.0)).alias("drag"))


def annualized_turnover(pos: DataFrame, by=(), ppy: int = 252, key="asset") -> DataFrame:
    """Mean per-date book turnover times periods per year."""
    t = pos.withColumn("__t", turnover("pos", key))
    d = t.groupBy(*by, "date").agg(F.coalesce(F.sum("__t"), F.lit(0.0)).alias("t"))
    return d.groupBy(*by).agg((F.avg("t") * ppy).alias("turnover"))


# One-way cost in basis points per liquidity quartile, most liquid first.
TIER_BPS = (1.0, 3.0, 6.0, 10.0)


def tiered_cost_bps(bars: DataFrame, start: str, tiers: tuple[float, ...] = TIER_BPS) -> DataFrame:
    """Right-closed quantile bins of average volume; the most liquid bin pays the first tier.

    Equal cut points collapse into one bin, as duplicate edges are dropped.
    """
    adv = bars.where(F.col("date") >= F.to_date(F.lit(start))).groupBy("asset").agg(F.avg("volume").alias("adv"))
    n = len(tiers)
    cuts = adv.agg(F.array_distinct(F.percentile("adv", F.array(*[F.lit(i / n) for i in range(n + 1)]))).alias("q")).scalar()
    # The lowest edge opens the first bin; every later edge strictly below the average moves up one.
    b = sum((F.when(F.col("adv") > F.get(cuts, F.lit(i)), 1).otherwise(0) for i in range(1, n)), F.lit(0))
    return adv.select("asset", "adv", F.element_at(F.array(*[F.lit(float(t)) for t in reversed(tiers)]), b + 1).alias("cost_bps"))


def sharpe(r: str = "pnl", ppy: int = 252, min_obs: int = 20) -> Column:
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= min_obs) & (sd > 0), div(F.avg(r), sd) * math.sqrt(ppy))


def wealth(r: str, key, order="date") -> Column:
    """Running product of 1 + r; a loss of all or more makes it zero or turns its sign. NULL returns change nothing."""
    g, w = 1 + F.col(r), running(key, order)
    size = F.exp(F.coalesce(F.sum(F.when(g != 0, F.ln(F.abs(g)))).over(w), F.lit(0.0)))
    turns = F.coalesce(F.sum((g < 0).cast("int")).over(w), F.lit(0))
    return F.when(F.max((g == 0).cast("int")).over(w) == 1, 0.0).otherwise(size * (1 - 2 * F.pmod(turns, F.lit(2))))


def wealth_log(r: str, key, order="date") -> Column:
    """Log of the running wealth; NULL where nothing or less is left."""
    w = wealth(r, key, order)
    return F.when(w > 0, F.ln(w))


def total_return(r: str) -> Column:
    """Aggregate: product of 1 + r, minus one."""
    return F.product(1 + F.col(r)) - 1


def drawdown(df: DataFrame, r: str, key, out: str = "drawdown", order="date") -> DataFrame:
    """Wealth over its running peak, minus one. Wealth starts at the first return."""
    w = running(key, order)
    return (df.withColumn("__w", wealth(r, key, order)).withColumn("__p", F.max("__w").over(w))
            .withColumn(out, div("__w", "__p") - 1).drop("__w", "__p"))


def performance(df: DataFrame, by: list[str], r: str = "pnl", ppy: int = 252, min_obs: int = 20) -> DataFrame:
    """Tear sheet from one grouped pass over returns with their drawdowns attached."""
    x = drawdown(df.where(F.col(r).isNotNull()), r, by, "__dd")
    n = F.count(r)
    a = x.groupBy(*by).agg(
        n.alias("n"), F.product(1 + F.col(r)).alias("__total"),
        (F.stddev_samp(r) * math.sqrt(ppy)).alias("ann_vol"),
        (F.stddev_samp(F.when(F.col(r) < 0, F.col(r))) * math.sqrt(ppy)).alias("__down"),
        F.min("__dd").alias("max_drawdown"), F.avg((F.col(r) > 0).cast("double")).alias("win_rate"))
    # a negative product has no yearly rate
    a = a.withColumn("ann_return", F.when(F.col("__total") >= 0, F.pow("__total", F.lit(float(ppy)) / F.col("n")) - 1))
    return a.where(F.col("n") >= min_obs).select(
        *by, "n", "ann_return", "ann_vol", div("ann_return", "ann_vol").alias("sharpe"),
        div("ann_return", "__down").alias("sortino"),
        F.when(F.col("max_drawdown") < 0, div("ann_return", F.abs("max_drawdown"))).alias("calmar"),
        "max_drawdown", "win_rate")


def split_tag(df: DataFrame, train_end: str, val_end: str, by: tuple[str, ...] = (), order="date", drop_first: bool = True) -> DataFrame:
    """train / validation / test; the later two lose their first row, whatever its date."""
    d = F.col(order)
    te, ve = F.to_date(F.lit(train_end)), F.to_date(F.lit(val_end))
    t = df.withColumn("split", F.when(d <= te, "train").when(d <= ve, "validation").otherwise("test"))
    if not drop_first:
        return t
    # The boundary row itself opens the next slice, so only a slice without it loses a real row.
    firsts = t.groupBy(*by).agg(
        F.max(F.when(d == te, True)).alias("__te"), F.max(F.when(d == ve, True)).alias("__ve"),
        F.min(F.when((d > te) & (d <= ve), d)).alias("__v0"), F.min(F.when(d > ve, d)).alias("__t0"))
    cols = ("__te", "__ve", "__v0", "__t0")
    if by:
        j = t.join(firsts, list(by))
    else:
        one = firsts.select(F.struct(*cols).alias("b")).scalar()
        j = t.select("*", *[one[c].alias(c) for c in cols])
    lose = ((F.col("split") == "validation") & F.col("__te").isNull() & (d == F.col("__v0"))) | (
        (F.col("split") == "test") & F.col("__ve").isNull() & (d == F.col("__t0")))
    return j.where(~F.coalesce(lose, F.lit(False))).drop("__te", "__ve", "__v0", "__t0")


def sharpe_by_split(df: DataFrame, by: list[str], r: str = "pnl", ppy: int = 252, min_obs: int = 20) -> DataFrame:
    """One grouped pass, one column per split."""
    out = [sharpe_if("split", s, r, ppy, min_obs).alias(s) for s in ("train", "validation", "test")]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def sharpe_if(c: str, v: str, r: str, ppy: int, min_obs: int) -> Column:
    x = F.when(F.col(c) == v, F.col(r))
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= min_obs) & (sd > 0), div(F.avg(x), sd) * math.sqrt(ppy))
