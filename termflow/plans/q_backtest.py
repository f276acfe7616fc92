"""Positions, returns, costs, performance."""
from pyspark.sql import Window as W, functions as F

from termflow.functions.cols import rounded, trailing
from termflow.operators import backtest as bt
from termflow.operators.signals import trend
from termflow.operators.xs import apply_multiplier, size_multiplier
from termflow.plans.registry import cte, query
from termflow.session import materialize
from termflow.sources import driver_views as dv, market as mk

TRAIN, VAL = "1999-12-31", "2000-12-31"
SPLIT = "case when date<=date '1999-12-31' then 'train' when date<=date '2000-12-31' then 'validation' else 'test' end"
# 31 December of both boundary years is a Friday only in 1999, so the test slice loses its first row.
cte("split_w", f"""select date, pnl, split from (select *, row_number() over (partition by split order by date) as k from
  (select *, {SPLIT} as split from pnl_w)) where split='train' or k>1 or
  (split='validation' and exists (select 1 from pnl_w where date=date '1999-12-31')) or
  (split='test' and exists (select 1 from pnl_w where date=date '2000-12-31'))""")
SH = "case when count({x})>=20 and stddev_samp({x})>0 then round(avg({x})/stddev_samp({x})*sqrt(52),5) end"


def sh(split, x="pnl"):
    return SH.format(x=f"case when split='{split}' then {x} end")


SPLITS_SQL = ", ".join(f"{sh(s)} as {s}" for s in ("train", "validation", "test"))


@query("tsmom_sharpe_by_split", "F14 B6 B4 B3 V1 S1", f"select {SPLITS_SQL} from split_w")
def _(spark, d):
    return rounded(bt.sharpe_by_split(bt.split_tag(mk.pnl_w(spark, d), TRAIN, VAL), [], ppy=52), 5)


@query("normalized_positions", "B3", "select asset, date, round(pos,6) as pos from pos_w")
def _(spark, d):
    return rounded(mk.pos_w(spark, d).select("asset", "date", "pos"))


@query("strategy_return_gross", "B4", "select date, round(pnl,6) as pnl from pnl_w")
def _(spark, d):
    return rounded(mk.pnl_w(spark, d))


cte("adv_w", "select asset, avg(volume) as adv from bars_w where date>=date '1999-01-01' group by asset")
cte("cost_w", """select asset, adv, case when adv<=q[1] then 10.0 when adv<=q[2] then 6.0 when adv<=q[3] then 3.0 else 1.0 end as cost_bps
  from adv_w, (select quantile_cont(adv, [0.25,0.5,0.75]) as q from adv_w)""")
cte("net_w", """select date, coalesce(sum(pos*ret),0)-coalesce(sum(t*cost_bps/10000),0) as pnl, coalesce(sum(t*cost_bps/10000),0) as drag,
  coalesce(sum(t),0) as turn from (select *, abs(pos-lag(pos) over (partition by asset order by date)) as t from pos_w) p
  left join cost_w c on p.asset=c.asset group by date""")


@query("liquidity_tiered_cost", "B15", "select asset, round(adv,6) as adv, cost_bps::double as cost_bps from cost_w")
def _(spark, d):
    return rounded(bt.tiered_cost_bps(dv.bars_w(spark, d), "1999-01-01"))


@query("strategy_return_net", "B4", "select date, round(pnl,6) as pnl from net_w")
def _(spark, d):
    return rounded(bt.backtest(mk.pos_w(spark, d), cost_bps=bt.tiered_cost_bps(dv.bars_w(spark, d), "1999-01-01").drop("adv")))


@query("cost_drag", "B14", "select date, round(drag,8) as drag from net_w")
def _(spark, d):
    return rounded(bt.cost_drag(mk.pos_w(spark, d), bt.tiered_cost_bps(dv.bars_w(spark, d), "1999-01-01").drop("adv")), 8)


@query("turnover_annualized", "B13", "select round(avg(turn)*52,5) as turnover from net_w")
def _(spark, d):
    return rounded(bt.annualized_turnover(mk.pos_w(spark, d), ppy=52), 5)


@query("turnover_per_asset", "B13", "select asset, date, round(abs(pos-lag(pos) over (partition by asset order by date)),6) as turnover from pos_w")
def _(spark, d):
    return rounded(mk.pos_w(spark, d).select("asset", "date", bt.turnover().alias("turnover")))


@query("strategy_return_per_asset", "B5", "select asset, date, round(lag(signal) over (partition by asset order by date)*ret,6) as pnl from sig_w")
def _(spark, d):
    return rounded(bt.backtest_per_asset(mk.sig_w(spark, d), "signal").select("asset", "date", "pnl"))


@query("per_asset_sharpe_ranked", "B6", """with x as (select asset, lag(signal) over (partition by asset order by date)*ret as pnl from sig_w),
s as (select asset, case when count(pnl)>=20 and stddev_samp(pnl)>0 then avg(pnl)/stddev_samp(pnl)*sqrt(52) end as sh from x group by asset)
select asset, round(sh,5) as sharpe, row_number() over (order by sh desc nulls last, asset) as pos from s""")
def _(spark, d):
    x = bt.backtest_per_asset(mk.sig_w(spark, d), "signal").groupBy("asset").agg(bt.sharpe("pnl", 52).alias("sharpe"))
    return rounded(x.withColumn("pos", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("sharpe"), "asset")).cast("long")), 5)


cte("sec_w", """select *, pnl/10 as r from (select s.sector, date, coalesce(sum(pos*ret),0) as pnl
  from pos_w join (select distinct asset as a, sector from sup) s on asset=s.a group by s.sector, date)""")
cte("dd_w", """select *, wl/nullif(max(wl) over (partition by sector order by date),0)-1 as dd from
  (select *, product(1+r) over (partition by sector order by date) as wl from sec_w)""")


def sector_streams(spark, d):
    """One return stream per sector, a tenth of its P&L: (sector, date, r)."""
    s = mk.pos_w(spark, d).groupBy("sector", "date").agg(F.coalesce(F.sum(F.col("pos") * F.col("ret")), F.lit(0.0)).alias("pnl"))
    return s.withColumn("r", F.col("pnl") / 10)


@query("tear_sheet", "B7", """select sector, n, round(ar,5) as ann_return, round(av,5) as ann_vol, round(ar/nullif(av,0),5) as sharpe,
 round(ar/nullif(dv,0),5) as sortino, case when mdd<0 then round(ar/abs(mdd),5) end as calmar, round(mdd,5) as max_drawdown, round(wr,5) as win_rate
 from (select sector, count(*) as n, case when product(1+r)>=0 then pow(product(1+r),52.0/count(*))-1 end as ar, stddev_samp(r)*sqrt(52) as av,
  stddev_samp(case when r<0 then r end)*sqrt(52) as dv, min(dd) as mdd, avg(case when r>0 then 1.0 else 0.0 end) as wr from dd_w group by sector)""")
def _(spark, d):
    return rounded(bt.performance(sector_streams(spark, d), ["sector"], "r", 52), 5)


@query("equity_curve_log", "B8", "select sector, date, case when wl>0 then round(ln(wl),5) end as log_wealth, round(wl,6) as wealth from dd_w")
def _(spark, d):
    s = sector_streams(spark, d).select("sector", "date", bt.wealth_log("r", "sector").alias("log_wealth"), bt.wealth("r", "sector").alias("wealth"))
    return rounded(s, 5, wealth=6)


@query("drawdown_series", "B9", "select sector, date, round(dd,6) as drawdown from dd_w")
def _(spark, d):
    return rounded(bt.drawdown(sector_streams(spark, d), "r", "sector").select("sector", "date", "drawdown"))


@query("rolling_sharpe", "B10", """select sector, date, case when count(r) over w=26 and stddev_samp(r) over w>1e-9 then round(avg(r) over w/stddev_samp(r) over w*sqrt(52),5) end as sharpe
from sec_w window w as (partition by sector order by date rows between 25 preceding and current row)""")
def _(spark, d):
    w = trailing(26, "sector")
    sd = F.stddev_samp("r").over(w)
    return rounded(sector_streams(spark, d).select("sector", "date", F.when(
        (F.count("r").over(w) >= 26) & (sd > 1e-9), F.avg("r").over(w) / sd * 52 ** 0.5).alias("sharpe")), 5)


@query("monthly_return_matrix", "B11", "select sector, year(date)::int as year, " + ", ".join(
    f"round(product(1+r) filter (where month(date)={m})-1,5) as m{m}" for m in range(1, 13)) + " from sec_w group by all")
def _(spark, d):
    s = sector_streams(spark, d).withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    p = s.groupBy("sector", "year").pivot("month", list(range(1, 13))).agg(bt.total_return("r"))
    return rounded(p.select("sector", "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)]), 5)


cte("spec_raw", """select asset, date, ret, volume, '4' as spec, 0.4*sign(close/lag(close,4) over (partition by asset order by date)-1)/nullif(vol,0) as signal from vol_w union all
 select asset, date, ret, volume, '12', 0.4*sign(close/lag(close,12) over (partition by asset order by date)-1)/nullif(vol,0) from vol_w union all
 select asset, date, ret, volume, '26', 0.4*sign(close/lag(close,26) over (partition by asset order by date)-1)/nullif(vol,0) from vol_w""")
cte("spec_pos", """select *, abs(pos-lag(pos) over (partition by spec, asset order by date)) as t from (select *, coalesce(p/nullif(sum(abs(p)) over (partition by spec, date),0),0) as pos
  from (select *, lag(signal) over (partition by spec, asset order by date) as p from spec_raw))""")
cte("spec_pnl", """select spec, date, coalesce(sum(pos*ret),0) as gross, coalesce(sum(pos*ret),0)-coalesce(sum(t*cost_bps/10000),0) as net, coalesce(sum(t),0) as turn
  from spec_pos p left join cost_w c on p.asset=c.asset group by spec, date""")
cte("spec_split", f"""select * from (select *, row_number() over (partition by spec, split order by date) as k from
  (select *, {SPLIT} as split from spec_pnl)) where split='train' or k>1 or
  (split='validation' and exists (select 1 from pnl_w where date=date '1999-12-31')) or
  (split='test' and exists (select 1 from pnl_w where date=date '2000-12-31'))""")


def spec_positions(spark, d, lookbacks=(4, 12, 26)):
    """Several momentum specs as rows of one plan."""
    v = mk.vol_w(spark, d)
    cols = [f"s{k}" for k in lookbacks]
    from termflow.operators.xs import vol_targeted_sign
    wide = v.select("asset", "sector", "date", "ret", "volume", *[vol_targeted_sign(trend.raw_momentum_rows("close", k), "vol", 0.4).alias(c) for k, c in zip(lookbacks, cols)])
    g = wide.unpivot(["asset", "sector", "date", "ret", "volume"], cols, "spec", "signal").withColumn("spec", F.substring("spec", 2, 9))
    return bt.positions(g, "signal", "daily", key=("spec", "asset"), by=("spec", "date"))


def spec_pnl(spark, d):
    """(spec, date, gross, net, turn) in one pass over the positions."""
    c = bt.tiered_cost_bps(dv.bars_w(spark, d), "1999-01-01").drop("adv")
    p = spec_positions(spark, d).withColumn("t", bt.turnover("pos", ("spec", "asset"))).join(c, "asset", "left")
    g = F.coalesce(F.sum(F.col("pos") * F.col("ret")), F.lit(0.0))
    drag = F.coalesce(F.sum(F.col("t") * F.col("cost_bps") / 10_000), F.lit(0.0))
    return p.groupBy("spec", "date").agg(g.alias("gross"), (g - drag).alias("net"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("turn"))


@query("spec_table", "B12", "select spec, " + ", ".join(
    f"{sh(s, x)} as {x}_{s}" for x in ("gross", "net") for s in ("train", "validation", "test")) + ", round(avg(turn)*52,5) as turnover from spec_split group by spec")
def _(spark, d):
    t = bt.split_tag(spec_pnl(spark, d), TRAIN, VAL, ("spec",))
    return rounded(t.groupBy("spec").agg(*[bt.sharpe_if("split", s, x, 52, 20).alias(f"{x}_{s}")
                                           for x in ("gross", "net") for s in ("train", "validation", "test")],
                                         (F.avg("turn") * 52).alias("turnover")), 5)


@query("validation_selected_winner", "B18", f"""with t as (select spec, {sh('validation', 'net')} as val, {sh('test', 'net')} as test from spec_split group by spec)
select arg_max(spec, val) as winner, max(val) as validation, arg_max(test, val) as test from t""")
def _(spark, d):
    t = rounded(bt.sharpe_by_split(bt.split_tag(spec_pnl(spark, d), TRAIN, VAL, ("spec",)), ["spec"], "net", 52), 5)
    return t.agg(F.max_by("spec", "validation").alias("winner"), F.max("validation").alias("validation"), F.max_by("test", "validation").alias("test"))


@query("overlay_comparison", "B19", f"""with o as (select 'sized' as variant, p.date, coalesce(sum(pos*mult*ret),0) as pnl from pos_w p left join mult_w m on p.date=m.date group by p.date
  union all select 'plain', date, pnl from pnl_w),
t as (select *, {SPLIT} as split from o),
k as (select *, row_number() over (partition by variant, split order by date) as k from t)
select variant, {SPLITS_SQL} from k where split='train' or k>1 or (split='validation' and exists (select 1 from pnl_w where date=date '1999-12-31'))
 or (split='test' and exists (select 1 from pnl_w where date=date '2000-12-31')) group by variant""")
def _(spark, d):
    p = mk.pos_w(spark, d).select("asset", "date", "pos", "ret")
    m = size_multiplier(dv.vix(spark, d), "close", 52, 10)
    both = bt.backtest(p).withColumn("variant", F.lit("plain")).unionByName(
        bt.backtest(apply_multiplier(p, m)).withColumn("variant", F.lit("sized")))
    return rounded(bt.sharpe_by_split(bt.split_tag(both, TRAIN, VAL, ("variant",)), ["variant"], ppy=52), 5)


FREQ_SQL = """select '{f}' as freq, date, ret, asset, lag(held) over (partition by asset order by date) as p from (
 with m as (select asset, {lab} as label, arg_max(signal, date) filter (where signal is not null) as v from sig_w group by asset, 2)
 select p.asset, p.date, p.ret, last_value(m.v ignore nulls) over (partition by p.asset order by p.date) as held
 from sig_w p left join m on p.asset=m.asset and p.date=m.label)"""


@query("frequency_comparison", "B17 B1 B2", f"""with p as (select 'daily' as freq, date, ret, asset, lag(signal) over (partition by asset order by date) as p from sig_w
 union all {FREQ_SQL.format(f='weekly', lab='date + cast((12-dayofweek(date))%7 as integer)')} union all {FREQ_SQL.format(f='monthly', lab='last_day(date)')}),
n as (select *, p/nullif(sum(abs(p)) over (partition by freq, date),0) as pos from p),
b as (select freq, date, coalesce(sum(pos*ret),0) as pnl from n group by freq, date),
t as (select *, {SPLIT} as split from b), k as (select *, row_number() over (partition by freq, split order by date) as k from t)
select freq, {SPLITS_SQL} from k where split='train' or k>1 or (split='validation' and exists (select 1 from pnl_w where date=date '1999-12-31'))
 or (split='test' and exists (select 1 from pnl_w where date=date '2000-12-31')) group by freq""")
def _(spark, d):
    s = materialize(mk.sig_w(spark, d).select("asset", "date", "ret", "signal"), "signal-panel")  # one signal plan for every frequency
    out = None
    for f in ("daily", "weekly", "monthly"):
        b = bt.backtest(bt.positions(s, "signal", f)).withColumn("freq", F.lit(f))
        out = b if out is None else out.unionByName(b)
    return rounded(bt.sharpe_by_split(bt.split_tag(out, TRAIN, VAL, ("freq",)), ["freq"], ppy=52), 5)
