"""Cross-sectional transforms."""

from termflow.functions.cols import rounded
from termflow.operators import xs as op
from termflow.plans.registry import cte, query
from termflow.sources import driver_views as dv, market as mk


def arank(x, part):
    return (f"(case when {x} is not null then rank() over (partition by {part} order by {x} nulls last) "
            f"+ (count({x}) over (partition by {part}, {x}) - 1)/2.0 end)")


@query("sign_and_scaled_signals", "X1 X2 X4 G4", f"""
select asset, date, sign(mom)::double as sgn, round(mom/nullif(vol,0),6) as scaled, round(0.4*sign(mom)/nullif(vol,0),6) as sized,
  round({arank('mom', 'date')}/count(mom) over (partition by date)-0.5,6) as ranked from mom_w""")
def _(spark, d):
    return rounded(mk.mom_w(spark, d).select(
        "asset", "date", op.binary("mom").alias("sgn"), op.continuous("mom", "vol").alias("scaled"),
        op.vol_targeted_sign("mom", "vol", 0.4).alias("sized"), op.rank_centered("mom").alias("ranked")))


@query("percentile_rank_volume", "X3", f"""
select asset, date, round({arank('volume', 'date')}/count(volume) over (partition by date)-0.5,6) as pct from panel_w""")
def _(spark, d):
    return rounded(mk.panel_w(spark, d).select("asset", "date", op.rank_centered("volume").alias("pct")))


@query("deadband_signal", "X5", """
select asset, date, case when mom is null then null when abs(mom) >= thr then round(0.4*sign(mom)/nullif(vol,0),6) else 0 end as signal
from (select *, case when count(mom) over w >= 20 then quantile_cont(abs(mom),0.5) over w end as thr from mom_w
  window w as (partition by asset order by date rows between 52 preceding and 1 preceding))""")
def _(spark, d):
    return rounded(op.deadband(mk.mom_w(spark, d), "mom", "vol", 0.4, 0.5, 52, 20).select("asset", "date", "signal"))


@query("sector_rank_demeaned", "X6", f"""
select asset, date, case when n>=2 then rk-(n+1)/2.0 end as score from (
  select asset, date, {arank('volume', 'date, sector')} as rk, count(volume) over (partition by date, sector) as n from panel_w)""")
def _(spark, d):
    return mk.panel_w(spark, d).select("asset", "date", op.sector_rank("volume").alias("score"))


@query("sector_mean_demeaned", "X7", """
select asset, date, case when count(ret) over s >= 2 then round(ret-avg(ret) over s,6) end as score from ret_w
window s as (partition by date, sector)""")
def _(spark, d):
    return rounded(mk.ret_w(spark, d).select("asset", "date", op.demean("ret").alias("score")))


@query("sector_average_return", "X8", "select date, sector, round(avg(ret),6) as ret from ret_w group by date, sector")
def _(spark, d):
    return rounded(op.sector_average(mk.ret_w(spark, d), "ret"))


@query("sector_expanding_mean", "X9", """with s as (select date, sector, avg(mom) as v from mom_w group by date, sector),
e as (select date, sector, avg(v) over (partition by sector order by date) as ref from s)
select p.asset, p.date, round(e.ref,6) as ref from panel_w p join e on p.date=e.date and p.sector=e.sector""")
def _(spark, d):
    return rounded(op.sector_expanding_mean(mk.mom_w(spark, d), "mom", "ref").select("asset", "date", "ref"))


cte("vix_w", """select cast(o_orderdate as date) + cast((12-dayofweek(cast(o_orderdate as date)))%7 as integer) as date,
  sum(cast(floor(o_totalprice*100+0.5) as bigint))/10000000.0::double/count(*) as close from orders group by 1""")
cte("mult_w", """select date, close, case when count(close) over w >= 10 then close/avg(close) over w end as mult from vix_w
  window w as (order by date rows between 52 preceding and 1 preceding)""")


@query("market_gauge_multiplier", "X10 S11", "select date, round(close,6) as close, round(mult,6) as mult from mult_w")
def _(spark, d):
    return rounded(op.size_multiplier(dv.vix(spark, d), "close", 52, 10))


@query("apply_size_multiplier", "X11", "select asset, p.date, round(pos*mult,6) as pos from pos_w p left join mult_w m on p.date=m.date")
def _(spark, d):
    m = op.size_multiplier(dv.vix(spark, d), "close", 52, 10)
    return rounded(op.apply_multiplier(mk.pos_w(spark, d), m).select("asset", "date", "pos"))


@query("train_period_scaled_signal", "X12", """select asset, date, round(signal/coalesce((select case when stddev_samp(signal)>0
  then stddev_samp(signal) end from sig_w where date<=date '1999-12-31'),1),6) as scaled from sig_w""")
def _(spark, d):
    return rounded(op.train_scaled(mk.sig_w(spark, d), "signal", "1999-12-31").select("asset", "date", "scaled"))
