"""Contract chains, front assignment, back-adjustment, carry and curve analytics."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termflow.functions.calendar import DAYS_PER_MONTH, code_month
from termflow.functions.cols import div, seq

YEAR_DAYS = 365.0


def month_no(year: str = "expiry_year", code: str = "expiry_code") -> Column:
    return F.col(year) * 12 + code_month(code)


def contract_chain(contracts: DataFrame) -> DataFrame:
    """(asset, contract_symbol, m, chain_idx) in expiry order."""
    d = contracts.select("asset", "contract_symbol", month_no().alias("m")).distinct()
    return d.withColumn("chain_idx", F.row_number().over(W.partitionBy("asset").orderBy("m", "contract_symbol")))


def front_fold(confirm: int, backstop: int):
    """Roll rule as a fold over one asset's dates; each row carries that date's listed legs."""
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        last = dict(zip(*[pdf["last_idx"].iloc[0], pdf["last_t"].iloc[0]]))
        front, pending, count, out = None, None, 0, []
        for t, idx, vol in zip(pdf["t"], pdf["idx"], pdf["vol"]):
            v = dict(zip(idx, vol))
            if front is None:
                front = max(idx, key=lambda i: (v[i], -i))
            nxt = next((i for i in idx if i > front), None)
            fv, nv = v.get(front) or 0.0, (v.get(nxt) or 0.0) if nxt is not None else 0.0
            if nxt is not None and nv > 0 and fv > 0 and nv > fv:
                count = count + 1 if pending == nxt else 1
                pending = nxt
            else:
                pending, count = None, 0
            ending = front in last and last[front] - t <= backstop
            if nxt is not None and ((pending is not None and count >= confirm) or ending):
                front, pending, count = nxt, None, 0
            out.append(front)
        return pd.DataFrame({"asset": pdf["asset"], "date": pdf["date"], "chain_idx": out, "status": "OK"})

    def safe(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return walk(pdf)
        except Exception as e:  # one bad asset must not fail the job: it is reported as a status row
            return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "date": [None], "chain_idx": [None], "status": [str(e)[:200]]})

    return safe


def assign_front(contracts: DataFrame, confirm: int = 2, backstop: int = 5, expiry: DataFrame | None = None,
                 end_guard: bool = False) -> DataFrame:
    """(asset, date, front_contract_symbol, status).

    The fold's input is one row per (asset, date), so a group is bounded by the calendar. The expiry
    proxy is a contract's last observed date; end_guard lifts it for contracts still listed on the
    asset's last date, and expiry(asset, contract_symbol, expiry_date) replaces it.
    """
    chain = contract_chain(contracts)
    c = contracts.select("asset", "date", "contract_symbol", "volume").join(chain, ["asset", "contract_symbol"])
    days = c.groupBy("asset", "date").agg(F.array_sort(F.collect_list(F.struct(F.col("chain_idx").alias("i"), F.col("volume").cast("double").alias("v")))).alias("legs"))
    days = days.withColumn("t", F.row_number().over(seq()))
    seen = c.groupBy("asset", "contract_symbol", "chain_idx").agg(F.max("date").alias("date"))
    if expiry is not None:
        seen = seen.join(expiry, ["asset", "contract_symbol"], "left").withColumn("date", F.coalesce("expiry_date", "date")).drop("expiry_date")
        # the last listed date at or before each expiry: one ordered pass over dates and expiries together
        none = F.lit(None).cast("int")
        u = days.select("asset", "date", "t", none.alias("chain_idx")).unionByName(seen.select("asset", "date", none.alias("t"), "chain_idx"))
        upto = W.partitionBy("asset").orderBy("date", F.col("chain_idx").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
        seen = u.withColumn("t", F.last("t", ignorenulls=True).over(upto)).where("chain_idx is not null and t is not null").select("asset", "chain_idx", "t")
    else:
        if end_guard:
            seen = seen.withColumn("end", F.max("date").over(W.partitionBy("asset"))).where("date < end").drop("end")
        seen = seen.join(days.select("asset", "date", "t"), ["asset", "date"])
    ends = seen.groupBy("asset").agg(F.collect_list("chain_idx").alias("last_idx"), F.collect_list("t").alias("last_t"))
    empty = F.array().cast("array<int>")
    x = days.join(ends, "asset", "left").select(
        "asset", "date", "t", F.col("legs.i").alias("idx"), F.col("legs.v").alias("vol"),
        F.coalesce("last_idx", empty).alias("last_idx"), F.coalesce("last_t", empty).alias("last_t"))
    f = x.groupBy("asset").applyInPandas(front_fold(confirm, backstop), "asset string, date date, chain_idx int, status string")
    return f.join(chain.select("asset", "chain_idx", F.col("contract_symbol").alias("front_contract_symbol")), ["asset", "chain_idx"], "left").drop("chain_idx")


def front_bars(front: DataFrame, contracts: DataFrame) -> DataFrame:
    """Unadjusted bars of whichever contract is front."""
    c = contracts.select("asset", "date", F.col("contract_symbol").alias("front_contract_symbol"), "open", "high", "low", "close", "volume")
    return front.join(c, ["asset", "date", "front_contract_symbol"], "left")


def back_adjust(raw: DataFrame, contracts: DataFrame) -> DataFrame:
    """Ratio back-adjustment: every bar times the product of the roll ratios after it."""
    prev = F.lag("front_contract_symbol").over(seq())
    x = raw.withColumn("__old", prev).withColumn("is_roll_date", F.coalesce(F.col("front_contract_symbol") != prev, F.lit(False)))
    # The new contract's close is the raw close; only the old contract's is looked up, and the front rows
    # are read once so the roll fold above them runs once.
    old = contracts.select("asset", "date", F.col("contract_symbol").alias("__old"), F.col("close").alias("__oc"))
    x = x.withColumn("__old", F.when(F.col("is_roll_date"), F.col("__old"))).join(old, ["asset", "date", "__old"], "left")
    ok = F.col("is_roll_date") & (F.col("__oc") > 0) & (F.col("close") > 0)
    x = x.withColumn("__g", F.when(ok, F.ln(F.col("close") / F.col("__oc"))).otherwise(0.0))
    later = W.partitionBy("asset").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, -1)
    f = F.exp(F.coalesce(F.sum("__g").over(later), F.lit(0.0)))
    return x.withColumn("__f", f).select(
        "asset", "date", "front_contract_symbol", *[F.col(c).alias(f"raw_{c}") for c in ("open", "high", "low", "close")],
        "volume", "is_roll_date", *[(F.col(c) * F.col("__f")).alias(f"adj_{c}") for c in ("open", "high", "low", "close")])


def curve_status(front: DataFrame) -> DataFrame:
    """(asset, status, days) of assign_front's rows: what failed, beside the curve that leaves it out."""
    return front.groupBy("asset", "status").agg(F.count_distinct("date").alias("days"))


def continuous_curve(contracts: DataFrame, **kw) -> DataFrame:
    """All assets in one plan; assets whose roll fold failed carry no rows and are listed by curve_status."""
    front = assign_front(contracts, **kw).where("status = 'OK'").drop("status")
    return back_adjust(front_bars(front, contracts), contracts)


def front_spread(front: DataFrame, spreads: DataFrame) -> DataFrame:
    """Quoted spread of the front against its nearest far leg, first non-null value per column."""
    s = spreads.withColumn("near_m", month_no("near_expiry_year", "near_expiry_code")).withColumn(
        "far_m", month_no("far_expiry_year", "far_expiry_code"))
    f = front.select("asset", "date", F.col("front_contract_symbol").alias("near_contract_symbol"))
    j = s.join(f, ["asset", "date", "near_contract_symbol"])

    def first(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("far_m"))).alias(c)

    return j.groupBy("asset", "date").agg(*[first(c) for c in ("near_contract_symbol", "far_contract_symbol", "close", "near_m")],
                                          F.min("far_m").alias("far_m"))


def _annual(x: Column, days: Column) -> Column:
    return F.when(days > 0, x * F.lit(YEAR_DAYS) / days)


def real_carry(front: DataFrame, spreads: DataFrame, contracts: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """Quoted spread over the near close, annualized. scale(asset, scale) rescales odd quotes."""
    s = front_spread(front, spreads)
    near = contracts.select("asset", "date", F.col("contract_symbol").alias("near_contract_symbol"), F.col("close").alias("near_close"))
    s = s.join(near, ["asset", "date", "near_contract_symbol"], "left")
    if scale is not None:
        s = s.join(scale, "asset", "left").withColumn("close", F.col("close") * F.coalesce("scale", F.lit(1.0)))
    days = (F.col("far_m") - F.col("near_m")) * DAYS_PER_MONTH
    return s.select("asset", "date", _annual(div("close", "near_close"), days).alias("carry"))


def proxy_carry(front: DataFrame, contracts: DataFrame) -> DataFrame:
    """Front close against the next listed contract priced that day: one lead per (asset, date)."""
    w = W.partitionBy("asset", "date").orderBy("m")
    c = contracts.where("close is not null").withColumn("m", month_no())
    c = c.withColumn("fc", F.lead("close").over(w)).withColumn("fm", F.lead("m").over(w)).select(
        "asset", "date", F.col("contract_symbol").alias("front_contract_symbol"), "close", "m", "fc", "fm")
    j = front.join(c, ["asset", "date", "front_contract_symbol"])
    x = _annual(div(F.col("close") - F.col("fc"), "close"), (F.col("fm") - F.col("m")) * DAYS_PER_MONTH)
    return j.select("asset", "date", x.alias("carry")).where("carry is not null")


def carry_panel(front: DataFrame, spreads: DataFrame, contracts: DataFrame, proxies: DataFrame) -> DataFrame:
    """Quoted carry, or the proxy for assets in proxies(asset), with an is_proxy flag."""
    real = real_carry(front.join(proxies, "asset", "left_anti"), spreads, contracts)
    px = proxy_carry(front.join(proxies, "asset", "left_semi"), contracts)
    return real.withColumn("is_proxy", F.lit(False)).unionByName(px.withColumn("is_proxy", F.lit(True)))


def off_panel(contracts: DataFrame, panel: DataFrame) -> DataFrame:
    """Contracts of assets that the panel does not have."""
    return contracts.join(panel.select("asset").distinct(), "asset", "left_anti")


def off_panel_curve(contracts: DataFrame, panel: DataFrame, **kw) -> DataFrame:
    """Continuous curve of every asset that has contracts but no panel series, by the same roll rule and back-adjustment."""
    return continuous_curve(off_panel(contracts, panel), **kw)


def off_panel_carry(curve: DataFrame, spreads: DataFrame, contracts: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """Quoted carry of off-panel assets against the front contracts of their own curve."""
    return real_carry(curve.select("asset", "date", "front_contract_symbol"), spreads, contracts, scale)


def quote_error(front: DataFrame, spreads: DataFrame, contracts: DataFrame) -> DataFrame:
    """|back-differenced - quoted| over the near close, for the front spread."""
    s = front_spread(front, spreads)
    near = contracts.select("asset", "date", F.col("contract_symbol").alias("near_contract_symbol"), F.col("close").alias("nc"))
    far = contracts.select("asset", "date", F.col("contract_symbol").alias("far_contract_symbol"), F.col("close").alias("fc"))
    j = s.join(near, ["asset", "date", "near_contract_symbol"], "left").join(far, ["asset", "date", "far_contract_symbol"], "left")
    return j.select("asset", "date", div(F.abs(F.col("nc") - F.col("fc") - F.col("close")), F.abs("nc")).alias("error")).where("error is not null")


def spread_carry_table(spreads: DataFrame, contracts: DataFrame) -> DataFrame:
    """Every quoted spread with both legs priced: carry in percent and the synthetic spread."""
    near = contracts.select("asset", "date", F.col("contract_symbol").alias("near_contract_symbol"), F.col("close").alias("near_close"))
    far = contracts.select("asset", "date", F.col("contract_symbol").alias("far_contract_symbol"), F.col("close").alias("far_close"))
    j = spreads.join(near, ["asset", "date", "near_contract_symbol"]).join(far, ["asset", "date", "far_contract_symbol"])
    days = (month_no("far_expiry_year", "far_expiry_code") - month_no("near_expiry_year", "near_expiry_code")) * DAYS_PER_MONTH
    return j.select("asset", "date", "spread_symbol", F.col("close").alias("spread_close"),
                    (_annual(div("close", "near_close"), days) * 100).alias("carry_pct"),
                    (F.col("near_close") - F.col("far_close")).alias("synthetic_spread"))


def curve_snapshot(contracts: DataFrame, as_of: str, active_days: int = 10) -> DataFrame:
    """Last traded row of each contract that printed within the window before as_of."""
    t = contracts.where((F.col("volume") > 0) & (F.col("date") <= F.to_date(F.lit(as_of))))
    s = t.groupBy("asset", "contract_symbol", "expiry_year", "expiry_code").agg(
        F.max("date").alias("last_price_date"), F.max_by("close", "date").alias("close"))
    return s.where(F.col("last_price_date") >= F.date_sub(F.to_date(F.lit(as_of)), active_days))


def curve_shape(rows: DataFrame, by: list[str]) -> DataFrame:
    """Contango when the farthest close is above the nearest; one contract has no shape."""
    m = month_no()
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_contracts"), F.min_by("close", m).alias("front_close"), F.max_by("close", m).alias("back_close"))
    shape = F.when(F.col("n_contracts") < 2, "single").when(F.col("back_close") > F.col("front_close"), "contango").otherwise("backwardation")
    return g.withColumn("curve_shape", shape)


def shape_history(contracts: DataFrame) -> DataFrame:
    s = curve_shape(contracts.where("volume > 0"), ["asset", "date"]).where("n_contracts >= 2")
    return s.withColumn("steepness_pct", div(F.col("back_close") - F.col("front_close"), "front_close") * 100)


def rank_history(contracts: DataFrame, max_rank: int = 10) -> DataFrame:
    """The first max_rank positions along each day's curve and their distance from the front."""
    w = W.partitionBy("asset", "date").orderBy(month_no(), "contract_symbol")
    r = contracts.where("volume > 0").withColumn("rank", F.row_number().over(w) - 1).withColumn("__f", F.first("close").over(w))
    return r.where(F.col("rank") < max_rank).select("asset", "date", "rank", "contract_symbol", "close", (F.col("close") - F.col("__f")).alias("close_minus_front"))


def richness(df: DataFrame, by: list[str], x: str, min_obs: int = 20, order: str = "date") -> DataFrame:
    """Latest value's percentile and z-score in its own history."""
    v = df.where(F.col(x).isNotNull())
    last = v.groupBy(*by).agg(F.max_by(x, order).alias("latest"), F.count(x).alias("n_obs"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    pct = v.join(last, by).groupBy(*by).agg((F.avg((F.col(x) <= F.col("latest")).cast("double")) * 100).alias("p"))
    ok = F.col("n_obs") >= min_obs
    return last.join(pct, by).select(*by, "n_obs", F.when(ok, F.col("p")).alias("percentile"),
                                     F.when(ok & (F.col("s") > 0), (F.col("latest") - F.col("m")) / F.col("s")).alias("zscore"))
