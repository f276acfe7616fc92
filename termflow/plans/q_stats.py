"""Combinatorial cross-validation, robust t-statistics, multiple testing, half-life comparison."""
from pyspark.sql import functions as F

from termflow.functions.cols import rounded
from termflow.operators import backtest as bt, stats as op
from termflow.operators.signals import relative_value as rv
from termflow.plans.q_backtest import SPLIT, SPLITS_SQL, sector_streams, spec_positions
from termflow.plans.q_rv import spreads
from termflow.plans.registry import cte, query
from termflow.session import materialize
from termflow.sources import driver_views as dv

cte("cfg", """select s.spec || '|' || n.sector as config, s.date, coalesce(sum(pos*ret),0) as pnl from spec_pos s join (select distinct asset as a, sector from sup) n on n.a=s.asset group by 1,2""")
cte("blk", "select date, g, row_number() over (partition by g order by date) as h, count(*) over (partition by g) as m from (select date, ntile(6) over (order by date)-1 as g from (select distinct date from cfg))")
cte("cmb", "select unnest(range(64)) as combo")
cte("sides", """select combo, date, side from (select combo, date, case when tr and h>hd and h<=m-td and m>hd+td then 'train' when not tr then 'test' end as side from (select *, (combo>>g)&1=1 as tr, case when g>0 and (combo>>(g-1))&1=0 then 5 else 0 end as hd,
  case when g<5 and (combo>>(g+1))&1=0 then 3 else 0 end as td from blk cross join (select cast(combo as bigint) as combo from cmb where bit_count(cast(combo as bigint))=3))) where side is not null""")


def configs(spark, d):
    """Twelve or more configurations: each momentum look-back in each sector."""
    p = spec_positions(spark, d).groupBy(F.concat_ws("|", "spec", "sector").alias("config"), "date").agg(
        F.coalesce(F.sum(F.col("pos") * F.col("ret")), F.lit(0.0)).alias("pnl"))
    return materialize(p, "configs")


@query("date_blocks", "T1", "select date, g, h, m from blk")
def _(spark, d):
    return op.date_blocks(configs(spark, d).select("date").distinct(), 6)


@query("block_combinations", "T2", "select g as block, count(distinct combo) as in_train from blk join sides using (date) where side='train' group by g")
def _(spark, d):
    dates = configs(spark, d).select("date").distinct()
    b = op.with_combos(op.date_blocks(dates, 6), 6, 3)
    return b.where("(shiftright(combo, g) & 1) = 1").groupBy(F.col("g").alias("block")).agg(F.count_distinct("combo").alias("in_train"))


@query("purge_and_embargo", "T3", "select combo, side, count(*) as n, min(date) as first, max(date) as last from sides group by combo, side")
def _(spark, d):
    s = op.purged_dates(configs(spark, d).select("date").distinct(), 6, 3, 3, 2)
    return s.groupBy(F.col("combo").cast("long").alias("combo"), "side").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


ST = "case when count({x})>=20 and stddev_samp({x})>0 then avg({x})/stddev_samp({x})*sqrt(252) end"
cte("cstats", f"""select combo, config, {ST.format(x="case when side='train' then pnl end")} as i, {ST.format(x="case when side='test' then pnl end")} as o from cfg join sides using (date) group by combo, config""")
cte("cscv_x", """select combo, winner, omega, ln(omega/(1-omega)) as logit from (select combo, config as winner, greatest(1e-6,least(1-1e-6,rk/(n+1))) as omega from (
  select *, row_number() over (partition by combo order by i desc nulls last, config) as k, case when o is not null then rank() over (partition by combo order by o nulls last)+(count(o) over (partition by combo, o)-1)/2.0 end as rk,
   count(*) over (partition by combo) as n, count(o) over (partition by combo) as no from cstats) where k=1 and i is not null and rk is not null and n-no<=0.5*n)""")


def result(spark, d):
    return op.cscv(configs(spark, d), 6, 3, 3, 2)


@query("cscv_logits", "T4", "select combo, winner, round(omega,6) as omega, round(logit,6) as logit from cscv_x")
def _(spark, d):
    return rounded(result(spark, d).withColumn("combo", F.col("combo").cast("long")))


@query("overfitting_probability", "T5", "select round(avg(case when logit<=0 then 1.0 else 0 end),6) as pbo, count(*) as combos from cscv_x")
def _(spark, d):
    return rounded(op.pbo(result(spark, d)))


@query("cscv_summary", "T7", """with c as (select winner, count(*) as n from cscv_x group by winner) select round(coalesce(sum(n) filter (where winner='12|ASIA'),0)/sum(n),6) as default_share, arg_max(winner, n*1000000+ascii(winner)*1000+length(winner)) as top_winner, max(n) as top_wins from c""".replace(
    "arg_max(winner, n*1000000+ascii(winner)*1000+length(winner))", "(select winner from c order by n desc, winner desc limit 1)"))
def _(spark, d):
    return rounded(op.cscv_summary(result(spark, d), "12|ASIA"))


cte("hac_e", """select sector, date, r, r-avg(r) over (partition by sector) as e, count(*) over (partition by sector) as n from sec_w""")


@query("hac_mean_tstat", "T8", """select sector, n, round(m,8) as mean, round(m*n/sqrt(s),5) as tstat from (select sector, count(*) as n, avg(r) as m, sum(e*e)+2*0.8*coalesce(sum(e*l1),0)+2*0.6*coalesce(sum(e*l2),0)+2*0.4*coalesce(sum(e*l3),0)+2*0.2*coalesce(sum(e*l4),0) as s from (
  select *, lag(e,1) over w as l1, lag(e,2) over w as l2, lag(e,3) over w as l3, lag(e,4) over w as l4 from hac_e window w as (partition by sector order by date)) group by sector)""")
def _(spark, d):
    return rounded(op.hac_mean(sector_streams(spark, d), "sector", "r", 4), 5, mean=8)


cte("reg_e", """select *, dx*(r-ym-b*dx) as e, r-ym-b*dx as u from (select *, x-avg(x) over (partition by sector) as dx, avg(r) over (partition by sector) as ym, covar_pop(r,x) over (partition by sector)/var_pop(x) over (partition by sector) as b from (
  select s.sector, s.date, s.r, lag(v.close) over (partition by s.sector order by s.date) as x from sec_w s left join vix_w v on v.date=s.date) where x is not null)""")


@query("hac_gauge_regression", "T9", """select sector, n, round(b,7) as slope, round(b*sxx/sqrt(s),5) as tstat, round(r2,6) as r2 from (select sector, count(*) as n, any_value(b) as b, sum(dx*dx) as sxx, 1-sum(u*u)/(var_pop(r)*count(*)) as r2,
 sum(e*e)+2*2.0/3*coalesce(sum(e*l1),0)+2*1.0/3*coalesce(sum(e*l2),0) as s from (select *, lag(e,1) over w as l1, lag(e,2) over w as l2 from reg_e window w as (partition by sector order by date)) group by sector)""")
def _(spark, d):
    from termflow.functions.cols import seq
    s = sector_streams(spark, d).join(dv.vix(spark, d), "date", "left").withColumn("x", F.lag("close").over(seq("sector")))
    return rounded(op.hac_slope(s, "sector", "r", "x", 2), 5, slope=7, r2=6)


# Two-sided normal tail by Simpson's rule on 200 steps.
P2 = "1-2*{z}/600/sqrt(2*pi())*list_sum([case when i=0 or i=200 then 1 when i%2=1 then 4 else 2 end*exp(-0.5*pow({z}*i/200,2)) for i in range(201)])"


@query("hac_pvalues", "T8", f"""select sector, n, mean, tstat, round({P2.format(z='abs(t)')},6) as p_value from (
 select sector, n, round(m,8) as mean, m*n/sqrt(s) as t, round(m*n/sqrt(s),5) as tstat from (
  select sector, count(*) as n, avg(r) as m, sum(e*e)+2*0.8*coalesce(sum(e*l1),0)+2*0.6*coalesce(sum(e*l2),0)+2*0.4*coalesce(sum(e*l3),0)+2*0.2*coalesce(sum(e*l4),0) as s from (
   select *, lag(e,1) over w as l1, lag(e,2) over w as l2, lag(e,3) over w as l3, lag(e,4) over w as l4 from hac_e window w as (partition by sector order by date)) group by sector))""")
def _(spark, d):
    h = op.hac_mean(sector_streams(spark, d), "sector", "r", 4)
    return rounded(h.withColumn("p_value", op.normal_two_sided(F.col("tstat"))), 5, mean=8, p_value=6)


cte("hlz", """select n.pair, n.date, n.chg, n.spread, case when count(spread) over a>=18 then (spread-avg(spread) over a)/nullif(stddev_samp(spread) over a,0) end as z26, case when count(spread) over b>=9 then (spread-avg(spread) over b)/nullif(stddev_samp(spread) over b,0) end as z13 from pair_z n
 window a as (partition by pair order by date rows between 25 preceding and current row), b as (partition by pair order by date rows between 12 preceding and current row)""")


@query("window_choice_comparison", "B20 B16", f"""with s as (select spec, pair, date, lag(sig) over (partition by spec, pair order by date) as w, chg from (select '26' as spec, pair, date, -z26 as sig, chg from hlz union all select '13', pair, date, -z13, chg from hlz)),
 n as (select *, w/nullif(sum(abs(w)) over (partition by spec, date),0) as pos from s), p as (select spec, date, coalesce(sum(pos*chg),0) as pnl from n group by 1,2), t as (select *, {SPLIT} as split from p), k as (select *, row_number() over (partition by spec, split order by date) as k from t)
select spec, {SPLITS_SQL} from k where split='train' or k>1 or (split='validation' and exists (select 1 from pnl_w where date=date '1999-12-31')) or (split='test' and exists (select 1 from pnl_w where date=date '2000-12-31')) group by spec""")
def _(spark, d):
    s = spreads(spark, d)
    x = s.select("pair", "date", rv.spread_change("spread").alias("ret"), (-rv.zscore("spread", 26)).alias("26"), (-rv.zscore("spread", 13)).alias("13"))
    g = x.unpivot(["pair", "date", "ret"], ["26", "13"], "spec", "signal")
    p = bt.backtest(bt.positions(g, "signal", "daily", key=("spec", "pair"), by=("spec", "date")), by=("spec", "date"))
    return rounded(bt.sharpe_by_split(bt.split_tag(p, "1999-12-31", "2000-12-31", ("spec",)), ["spec"], ppy=52), 5)


@query("pair_leg_costs", "B16", "select pair, a.cost_bps+b.cost_bps as cost_bps from pairs join cost_w a on a.asset=leg_y join cost_w b on b.asset=leg_x")
def _(spark, d):
    from termflow.plans.q_rv import registry
    legs = registry(spark, d).select("pair", F.explode(F.array("leg_y", "leg_x")).alias("asset"))
    return legs.join(bt.tiered_cost_bps(dv.bars_w(spark, d), "1999-01-01"), "asset").groupBy("pair").agg(F.sum("cost_bps").alias("cost_bps"))
