"""Signal blends."""
from pyspark.sql import functions as F

from termflow.functions.cols import rounded
from termflow.operators import backtest as bt, combine as op
from termflow.plans.q_backtest import spec_positions
from termflow.plans.q_xs import arank
from termflow.plans.registry import cte, query

cte("spec_f", "select *, lead(ret) over (partition by spec, asset order by date) as fwd from spec_raw")


def specs(spark, d):
    from termflow.functions.cols import seq
    p = spec_positions(spark, d)
    return p.withColumn("fwd", F.lead("ret").over(seq(("spec", "asset"))))


@query("equal_and_fixed_blend", "K1", """select asset, date, case when count(signal)=3 then round(avg(signal),6) end as equal,
 case when count(signal)=3 then round(sum(signal*case spec when '4' then 0.5 when '12' then 0.3 else 0.2 end),6) end as fixed from spec_raw group by asset, date""")
def _(spark, d):
    s = specs(spark, d).select("asset", "date", "spec", "signal")
    w = F.when(F.col("spec") == "4", 0.5).when(F.col("spec") == "12", 0.3).otherwise(0.2)
    full = F.count("signal") == 3
    return rounded(s.groupBy("asset", "date").agg(F.when(full, F.avg("signal")).alias("equal"), F.when(full, F.sum(w * F.col("signal"))).alias("fixed")))


@query("rank_blend", "K1", f"""select asset, date, case when count(r)=3 then round(avg(r),6) end as alpha from (select asset, date,
 {arank('signal', 'spec, date')}/count(signal) over (partition by spec, date) as r from spec_raw) group by asset, date""")
def _(spark, d):
    return rounded(op.rank_blend(specs(spark, d).select("asset", "date", "spec", "signal"), 3))


cte("ic_x", f"""select spec, date, case when count(*)>=2 and stddev_samp(a)*stddev_samp(b)>0 then covar_samp(a,b)/(stddev_samp(a)*stddev_samp(b)) end as ic from (
  select spec, date, {arank('signal', 'spec, date')} as a, {arank('fwd', 'spec, date')} as b from spec_f where signal is not null and fwd is not null) group by spec, date""")
cte("icw_x", """select spec, date, case when coalesce(sum(w) over (partition by date),0)<1e-8 then 1.0/3 else w/sum(w) over (partition by date) end as weight from (
  select c.spec, c.date, case when count(ic) over p>=20 then greatest(avg(ic) over p,0) end as w from (select distinct spec, date from spec_raw) c left join ic_x i on c.spec=i.spec and c.date=i.date
  window p as (partition by c.spec order by c.date rows between 52 preceding and 1 preceding))""")


@query("daily_rank_ic", "K2", "select spec, date, round(ic,6) as ic from ic_x")
def _(spark, d):
    return rounded(op.spearman_ic(specs(spark, d)))


@query("ic_weighted_blend", "K2", """select asset, s.date, case when count(signal*weight)=3 then round(sum(signal*weight),6) end as alpha from spec_raw s left join icw_x w on s.spec=w.spec and s.date=w.date group by asset, s.date""")
def _(spark, d):
    s = specs(spark, d)
    w = op.ic_weights(op.spearman_ic(s), s.select("spec", "date").distinct(), 3, 52)
    return rounded(op.weighted_blend(s.select("asset", "date", "spec", "signal"), w, 3))


cte("rpw_x", """select spec, date, case when coalesce(sum(w) over (partition by date),0)<1e-8 then 1.0/3 else w/sum(w) over (partition by date) end as weight from (
  select spec, date, case when count(gross) over p>=20 and stddev_samp(gross) over p>0 then 1/stddev_samp(gross) over p end as w from spec_pnl
  window p as (partition by spec order by date rows between 52 preceding and 1 preceding))""")


@query("inverse_vol_blend", "K3", """select asset, s.date, case when count(signal*weight)=3 then round(sum(signal*weight),6) end as alpha from spec_raw s left join rpw_x w on s.spec=w.spec and s.date=w.date group by asset, s.date""")
def _(spark, d):
    s = specs(spark, d)
    pnl = bt.backtest(s, by=("spec", "date"))
    return rounded(op.weighted_blend(s.select("asset", "date", "spec", "signal"), op.inverse_vol_weights(pnl, 3, 52), 3))


@query("confirmation_filter", "K4", """select asset, date, round(p*case when sign(p)=sign(c) then 1.0 else 0.25 end,6) as alpha from (select asset, date, max(signal) filter (where spec='12') as p,
 max(signal) filter (where spec='4') as c from spec_raw group by asset, date)""")
def _(spark, d):
    s = specs(spark, d).groupBy("asset", "date").agg(F.max(F.when(F.col("spec") == "12", F.col("signal"))).alias("p"),
                                                      F.max(F.when(F.col("spec") == "4", F.col("signal"))).alias("c"))
    return rounded(s.select("asset", "date", op.confirm("p", "c", 1.0, 0.25).alias("alpha")))
