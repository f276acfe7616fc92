"""Book registry: signal specs, universes and winners as rows of one plan."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from termflow.functions.cols import col, gated, keys, prior, seq
from termflow.operators import backtest as bt, combine
from termflow.operators.signals import cross_section, trend
from termflow.operators.xs import vol_targeted_sign
from termflow.session import materialize

FLAVOURS = ("tsmom_alone", "equal_weight", "fixed_70_30", "ic_weighted", "risk_parity", "confirmation", "tsmom_deadband", "tsmom_seasonal")
#: The flavour that needs no blend.
DEFAULT_FLAVOUR = "tsmom_alone"


def flavour_inputs(panel: DataFrame, seasons: dict[str, tuple[int, int]], lookback: int, cross: tuple[int, int], target: float,
                   deadband: tuple[float, int, int], close="close", vol="vol", ret="ret") -> DataFrame:
    """Momentum, crossover, dead-band threshold, season weight and the next return, from one sort by asset."""
    q, window, min_periods = deadband
    x = panel.withColumn("__m", trend.raw_momentum_rows(close, lookback)).withColumn("__c", trend.crossover_raw(close, *cross))
    x = x.withColumn("fwd", F.lead(ret).over(seq())).withColumn("__t", gated(F.percentile(F.abs("__m"), F.lit(q)), "__m", prior(window, "asset"), min_periods))
    x = cross_section.seasonal_weight(x, seasons, out="season")
    on = F.coalesce(F.abs("__m") >= F.col("__t"), F.lit(False))
    return x.withColumns({
        "mom": vol_targeted_sign("__m", vol, target), "cross": vol_targeted_sign("__c", vol, target),
        "dead": F.when(F.col("__m").isNotNull(), F.when(on, vol_targeted_sign("__m", vol, target)).otherwise(0.0))}).drop("__m", "__c", "__t")


def trend_flavours(panel: DataFrame, seasons: dict[str, tuple[int, int]], lookback: int = 252, cross: tuple[int, int] = (50, 200), target: float = 0.40,
                   deadband: tuple[float, int, int] = (0.5, 252, 60), memory: int = 252, min_obs: int = 20, agree: float = 1.0, disagree: float = 0.0, ret="ret") -> DataFrame:
    """(flavour, asset, date, ret, signal): eight ways to trade momentum and crossover, each a column expression of one panel.

    The blend weights are by date, so they come from calendar-sized tables: earlier rank correlations with the next return, and earlier
    volatilities of each signal's own strategy (momentum held by month, crossover by row). A blend is missing where a signal is.
    """
    x = materialize(flavour_inputs(panel, seasons, lookback, cross, target, deadband, ret=ret).select("asset", "date", ret, "fwd", "mom", "cross", "dead", "season"), "flavour-inputs")
    two = x.unpivot(["asset", "date", ret, "fwd"], ["mom", "cross"], "spec", "signal")
    cal = x.select("date").distinct().select("date", F.explode(F.array(F.lit("mom"), F.lit("cross"))).alias("spec"))
    ic = combine.ic_weights(combine.spearman_ic(two), cal, 2, memory, min_obs)
    pnl = None
    for spec, freq in (("mom", "monthly"), ("cross", "daily")):
        p = bt.backtest(bt.positions(x, spec, freq), ret=ret).withColumn("spec", F.lit(spec))
        pnl = p if pnl is None else pnl.unionByName(p)
    rp = combine.inverse_vol_weights(pnl, 2, memory, min_obs)
    w = ic.withColumnRenamed("weight", "ic").join(rp.withColumnRenamed("weight", "rp"), ["spec", "date"], "full")
    w = w.groupBy("date").agg(*[F.max(F.when(F.col("spec") == s, F.col(c))).alias(f"{c}_{s}") for c in ("ic", "rp") for s in ("mom", "cross")])
    x = x.join(w, "date", "left")
    m, c = F.col("mom"), F.col("cross")
    made = {
        "tsmom_alone": m, "equal_weight": (m + c) / 2, "fixed_70_30": 0.7 * m + 0.3 * c, "ic_weighted": F.col("ic_mom") * m + F.col("ic_cross") * c,
        "risk_parity": F.col("rp_mom") * m + F.col("rp_cross") * c, "confirmation": combine.confirm("mom", "cross", agree, disagree), "tsmom_deadband": F.col("dead"), "tsmom_seasonal": m * F.col("season")}
    rows = F.array(*[F.struct(F.lit(f).alias("flavour"), made[f].alias("signal")) for f in FLAVOURS])
    return x.select("asset", "date", F.col(ret).alias("ret"), F.explode(rows).alias("f")).select("f.flavour", "asset", "date", "ret", "f.signal")


def registered_books(signals: DataFrame, books: DataFrame, members: DataFrame, train_end: str, min_frac: float = 0.90) -> DataFrame:
    """(book, asset, date, alpha): every book's alphas in one plan.

    signals(spec, asset, date, ret, signal), books(book, spec), members(book, asset). An asset is active in a book with some signal and
    enough return rows; alphas are divided by the book's pooled deviation up to train_end (1 where that is unusable).
    """
    x = signals.join(books, "spec").join(members, ["book", "asset"], "left_semi")
    g = x.groupBy("book", "asset").agg(F.count("signal").alias("n"), (F.count("ret") / F.count(F.lit(1))).alias("cover"))
    x = x.join(g.where((F.col("n") > 0) & (F.col("cover") >= min_frac)).select("book", "asset"), ["book", "asset"], "left_semi")
    sd = x.where(F.col("date") <= F.to_date(F.lit(train_end))).groupBy("book").agg(F.stddev_samp("signal").alias("sd"))
    x = x.join(sd, "book", "left")
    return x.select("book", "asset", "date", "ret", (F.col("signal") / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)).alias("alpha"))


def spec_sharpes(specs: DataFrame, cost_bps: DataFrame, train_end: str, val_end: str, freq: str = "weekly", key="pair", ppy: int = 252, x="signal", ret="ret") -> DataFrame:
    """(key, spec, train, validation, test): net Sharpe of every spec of every key, each traded alone at unit size.

    specs(key, spec, date, ret, signal), cost_bps(key, cost_bps).
    """
    k = (*keys(key), "spec")
    pos = bt.positions(specs, x, freq, key=k, by=(*k, "date"))
    net = pos.withColumn("__t", bt.turnover("pos", k)).join(cost_bps, list(keys(key)), "left")
    gross = F.coalesce(F.col("pos") * F.col(ret), F.lit(0.0))
    net = net.select(*k, "date", (gross - F.coalesce(F.col("__t") * F.col("cost_bps") / 10_000, F.lit(0.0))).alias("pnl"))
    return bt.sharpe_by_split(bt.split_tag(net, train_end, val_end, k), list(k), ppy=ppy)


def chosen_specs(specs: DataFrame, winners: DataFrame, key="pair") -> DataFrame:
    """Rows of each key's winning spec only; winners(key, winner)."""
    k = list(keys(key))
    return specs.join(winners.select(*k, F.col("winner").alias("spec")), [*k, "spec"])


def leg_costs(legs: DataFrame, cost_bps: DataFrame, key="pair") -> DataFrame:
    """(key, cost_bps): sum of the legs' one-way costs, a leg without figures costing nothing; legs(key, asset)."""
    return legs.join(cost_bps.select("asset", "cost_bps"), "asset", "left").groupBy(*keys(key)).agg(F.sum(F.coalesce(col("cost_bps"), F.lit(0.0))).alias("cost_bps"))
