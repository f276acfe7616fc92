"""Momentum, breakout channels, crossover."""
from pyspark.sql import functions as F

from termflow.functions.cols import rounded
from termflow.operators import backtest as bt
from termflow.operators.signals import trend as op
from termflow.plans.registry import cte, query
from termflow.session import materialize
from termflow.sources import market as mk

LOOKBACKS = [4, 8, 12, 26]
PAIRS = [(4, 12), (8, 26), (13, 52)]


@query("momentum_with_skip", "G1", """select asset, date, round(lag(close,1) over w/lag(close,13) over w-1,6) as mom from panel_w
window w as (partition by asset order by date)""")
def _(spark, d):
    return rounded(mk.panel_w(spark, d).select("asset", "date", op.raw_momentum_rows("close", 12, 1).alias("mom")))


@query("tsmom_signal", "G2", "select asset, date, round(signal,6) as signal from sig_w")
def _(spark, d):
    return rounded(op.tsmom(mk.vol_w(spark, d), lookback_months=12, per_month=1).select("asset", "date", "signal"))


cte("grid_w", " union all ".join(
    f"select asset, date, ret, {k} as lookback, 0.4*sign(close/lag(close,{k}) over (partition by asset order by date)-1)/nullif(vol,0) as signal from vol_w"
    for k in LOOKBACKS))


@query("momentum_lookback_grid", "G3", "select asset, date, lookback, round(signal,6) as signal from grid_w")
def _(spark, d):
    return rounded(op.momentum_grid(mk.vol_w(spark, d), LOOKBACKS, per_month=1))


@query("momentum_feature_set", "G4", """select asset, date, sign(m)::double as sgn, round(m/nullif(vol,0),6) as scaled,
  round((case when m is not null then rank() over (partition by date order by m nulls last)+(count(m) over (partition by date, m)-1)/2.0 end)
   /count(m) over (partition by date)-0.5,6) as ranked
 from (select *, lag(close,1) over (partition by asset order by date)/lag(close,13) over (partition by asset order by date)-1 as m from vol_w)""")
def _(spark, d):
    from termflow.operators import xs
    x = mk.vol_w(spark, d).withColumn("m", op.raw_momentum_rows("close", 12, 1))
    return rounded(x.select("asset", "date", xs.binary("m").alias("sgn"), xs.continuous("m", "vol").alias("scaled"),
                            xs.rank_centered("m").alias("ranked")))


@query("lookback_holding_sharpe_grid", "G5", """
with g as (select distinct asset, date from grid_w),
m as (select asset, lookback, year(date)*12+month(date) as mi, last_day(date) as label,
   arg_max(signal,date) filter (where signal is not null) as v from grid_w group by all),
h as (select 1 as hold union all select 2 union all select 3),
b as (select asset, lookback, hold, label, avg(x.v) as v from (select m.asset, m.lookback, h.hold, m.label, n.v from m cross join h
    join m n on n.asset=m.asset and n.lookback=m.lookback and n.mi between m.mi-h.hold+1 and m.mi) x group by all having count(x.v)=hold),
p as (select q.asset, q.date, q.ret, q.lookback, h.hold, last_value(b.v ignore nulls) over (partition by q.asset, q.lookback, h.hold order by q.date) as held
   from grid_w q cross join h left join b on b.asset=q.asset and b.lookback=q.lookback and b.hold=h.hold and b.label=q.date),
l as (select *, lag(held) over (partition by asset, lookback, hold order by date) as w from p),
s as (select lookback, hold, date, coalesce(sum(ret*w/nullif(gg,0)),0) as pnl from (select *, sum(abs(w)) over (partition by lookback, hold, date) as gg from l) group by all)
select lookback, round(max(case when hold=1 then sh end),5) as hold_1, round(max(case when hold=2 then sh end),5) as hold_2,
 round(max(case when hold=3 then sh end),5) as hold_3
from (select lookback, hold, avg(pnl)/stddev_samp(pnl)*sqrt(52) as sh from s group by lookback, hold) group by lookback""")
def _(spark, d):
    # the grid is written once, with the returns; every holding period reads it
    g = materialize(op.momentum_grid(mk.vol_w(spark, d), LOOKBACKS, per_month=1, keep=("ret",)), "lookback-grid")
    key = ("asset", "lookback")
    out = None
    for hold in (1, 2, 3):
        p = bt.positions(g, "signal", "monthly", hold, key, ("date", "lookback"))
        s = bt.backtest(p, by=("lookback", "date")).withColumn("hold", F.lit(hold))
        out = s if out is None else out.unionByName(s)
    sh = [F.when(F.count(F.when(F.col("hold") == h, 1)) >= 20, (
        F.avg(F.when(F.col("hold") == h, F.col("pnl"))) / F.stddev_samp(F.when(F.col("hold") == h, F.col("pnl"))) * 52 ** 0.5)).alias(f"hold_{h}")
        for h in (1, 2, 3)]
    return rounded(out.groupBy("lookback").agg(*sh), 5)


@query("donchian_channels", "G6", """select asset, date, case when count(close) over a=13 then max(close) over a end as hi_13,
  case when count(close) over a=13 then min(close) over a end as lo_13, case when count(close) over b=6 then max(close) over b end as hi_6,
  case when count(close) over b=6 then min(close) over b end as lo_6 from panel_w
window a as (partition by asset order by date rows between 13 preceding and 1 preceding),
  b as (partition by asset order by date rows between 6 preceding and 1 preceding)""")
def _(spark, d):
    return op.donchian_channels(mk.panel_w(spark, d), [13, 6]).select("asset", "date", "hi_13", "lo_13", "hi_6", "lo_6")


@query("sma_crossover_raw", "G9", """select asset, date, round(case when count(close) over a>=2 then avg(close) over a end
  - case when count(close) over b>=8 then avg(close) over b end,6) as spread from panel_w
window a as (partition by asset order by date rows between 3 preceding and current row),
  b as (partition by asset order by date rows between 11 preceding and current row)""")
def _(spark, d):
    return rounded(mk.panel_w(spark, d).select("asset", "date", op.crossover_raw("close", 4, 12).alias("spread")))


def _pair_sql(f, s):
    return f"""select asset, date, '{f}/{s}' as pair, round(0.4*sign(case when count(close) over a>={int(f * .7)} then avg(close) over a end
  - case when count(close) over b>={int(s * .7)} then avg(close) over b end)/nullif(vol,0),6) as signal from vol_w
window a as (partition by asset order by date rows between {f - 1} preceding and current row),
  b as (partition by asset order by date rows between {s - 1} preceding and current row)"""


@query("crossover_pair_signals", "G10", " union all ".join(f"({_pair_sql(*p)})" for p in PAIRS))
def _(spark, d):
    return rounded(op.crossover_pairs(mk.vol_w(spark, d), PAIRS))
