"""Volatility and forecast evaluation."""
from pyspark.sql import functions as F

from termflow.functions.cols import rounded, safe_log
from termflow.operators import vol as op
from termflow.plans.registry import cte, query
from termflow.sources import market as mk


@query("safe_log_ohlc", "V2", """
select asset, date, case when open>0 then round(ln(open),6) end as ln_open, case when close>0 then round(ln(close),6) end as ln_close,
  case when low-1000>0 then round(ln(low-1000),6) end as ln_low_net from panel_w""")
def _(spark, d):
    return rounded(mk.panel_w(spark, d).select(
        "asset", "date", safe_log("open").alias("ln_open"), safe_log("close").alias("ln_close"),
        safe_log(F.col("low") - 1000).alias("ln_low_net")))


def yz_sql(w, ann, go, g, extra=""):
    k = 0.34 / (1.34 + (w + 1) / (w - 1))
    return f"""
select *, case when count(ro) over w >= {go} and count(rc) over w >= {g} then
  sqrt(greatest(var_samp(ro) over w + {k!r}*var_samp(rc) over w + {1 - k!r}*avg(rs) over w, 0))*{ann} end as v{extra}
from (select asset, date, {{ro}} as ro, ln(close)-ln(open) as rc,
   (ln(high)-ln(close))*(ln(high)-ln(open))+(ln(low)-ln(close))*(ln(low)-ln(open)) as rs from {{src}})
window w as (partition by asset order by date rows between {w - 1} preceding and current row)"""


RO = "ln(open)-lag(ln(close)) over (partition by asset order by date)"
ROLL = f"case when month(date)<>month(date-7) then null else {RO} end"


@query("yang_zhang_vol", "V3", f"select asset, date, round(v,6) as vol from ({yz_sql(26, 'sqrt(52)', 7, 18).format(ro=ROLL, src='panel_w')})")
def _(spark, d):
    p = mk.panel_w(spark, d).withColumn("is_roll", F.month("date") != F.month(F.date_sub("date", 7)))
    return rounded(op.yang_zhang(p, 26, roll="is_roll", ppy=52).select("asset", "date", "vol"))


@query("yang_zhang_multi_horizon", "V4", f"""
with a as ({yz_sql(8, '1', 8, 8).format(ro=RO, src='panel_w')}), b as ({yz_sql(13, '1', 13, 13).format(ro=RO, src='panel_w')}),
c as ({yz_sql(26, '1', 26, 26).format(ro=RO, src='panel_w')})
select a.asset, a.date, round(a.v,6) as vol_8, round(b.v,6) as vol_13, round(c.v,6) as vol_26
from a join b using (asset, date) join c using (asset, date)""")
def _(spark, d):
    return rounded(op.yang_zhang_strict(mk.panel_w(spark, d), (8, 13, 26)).select("asset", "date", "vol_8", "vol_13", "vol_26"))


@query("volatility_snapshot", "V5", "select asset, date, round(vol*sqrt(252),6) as vol from vol_w where date=(select max(date) from vol_w)")
def _(spark, d):
    return rounded(op.latest_snapshot(mk.vol_w(spark, d), ["vol"]))


@query("realized_vol_trailing", "V8", "select asset, date, round(vol,6) as vol from vol_w")
def _(spark, d):
    return rounded(mk.vol_w(spark, d).select("asset", "date", "vol"))


cte("est_w", """select asset, sector, date, vol as rv26,
  case when count(ret) over w13 >= 6 then stddev_samp(ret) over w13*sqrt(52) end as rv13,
  case when count(ret) over f4 = 4 then sum(ret*ret) over f4*52/4 end as fwd4,
  case when count(ret) over f8 = 8 then sum(ret*ret) over f8*52/8 end as fwd8 from vol_w
  window w13 as (partition by asset order by date rows between 12 preceding and current row),
  f4 as (partition by asset order by date rows between 1 following and 4 following),
  f8 as (partition by asset order by date rows between 1 following and 8 following)""")
cte("loss_w", """select asset, sector, date, h, estimator, case when x>0 then x-ln(x)-1 end as qlike, se from (
  select asset, sector, date, h, estimator, case when fv>0 then rv/fv end as x, (sqrt(fv)-sqrt(rv))**2 as se from (
   select asset, sector, date, 4 as h, 'rv13' as estimator, rv13*rv13 as fv, fwd4 as rv from est_w union all
   select asset, sector, date, 4, 'rv26', rv26*rv26, fwd4 from est_w union all
   select asset, sector, date, 8, 'rv13', rv13*rv13, fwd8 from est_w union all
   select asset, sector, date, 8, 'rv26', rv26*rv26, fwd8 from est_w))""")
cte("aloss_w", """select h, estimator, asset, sector, case when count(qlike)>=20 then avg(qlike) end as loss,
  case when count(se)>=20 then avg(se) end as mse from loss_w group by all""")


def estimates(spark, d):
    v = mk.vol_w(spark, d)
    return v.select("asset", "sector", "date", F.col("vol").alias("rv26"), op.realized_vol("ret", 13, 52).alias("rv13"),
                    *[op.forward_variance("ret", h, 52).alias(f"fwd{h}") for h in (4, 8)])


def losses(spark, d):
    """Long by (horizon, estimator): one explode, not one join per pair."""
    e = estimates(spark, d)
    combos = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(n).alias("estimator"), (F.col(n) * F.col(n)).alias("fv"), F.col(f"fwd{h}").alias("rv"))
                       for h in (4, 8) for n in ("rv13", "rv26")])
    x = e.select("asset", "sector", "date", F.explode(combos).alias("c")).select("asset", "sector", "date", "c.*")
    return x.withColumn("qlike", op.qlike("fv", "rv")).withColumn("se", op.mse_vol("fv", "rv"))


@query("forward_realized_variance", "V9", "select asset, date, round(fwd4,5) as fwd4, round(fwd8,5) as fwd8 from est_w")
def _(spark, d):
    return rounded(estimates(spark, d).select("asset", "date", "fwd4", "fwd8"), 5)


@query("qlike_and_squared_loss", "V10 V11", "select asset, date, h, estimator, round(qlike,5) as qlike, round(se,5) as se from loss_w")
def _(spark, d):
    return rounded(losses(spark, d).select("asset", "date", "h", "estimator", "qlike", "se"), 5)


@query("mean_loss_per_asset", "V12", """select h, estimator, asset, case when count(qlike)>=20 then round(avg(qlike),5) end as loss,
  count(qlike) as n from loss_w group by h, estimator, asset""")
def _(spark, d):
    return rounded(op.mean_loss(losses(spark, d), "qlike", ["h", "estimator", "asset"]), 5)


@query("estimator_comparison_by_horizon", "V13", """select h, estimator, round(avg(loss),5) as qlike, round(avg(mse),5) as mse
  from aloss_w group by h, estimator""")
def _(spark, d):
    x = losses(spark, d).groupBy("h", "estimator", "asset").agg(*[
        F.when(F.count(c) >= 20, F.avg(c)).alias(c) for c in ("qlike", "se")])
    return rounded(x.groupBy("h", "estimator").agg(F.avg("qlike").alias("qlike"), F.avg("se").alias("mse")), 5)


@query("best_estimator_per_asset", "V14", """select h, asset, arg_min(estimator, loss) as winner, round(max(loss)-min(loss),5) as margin
  from aloss_w group by h, asset having count(loss)=2""")
def _(spark, d):
    return rounded(op.per_asset_winner(op.mean_loss(losses(spark, d), "qlike", ["h", "estimator", "asset"]), 2, ("h", "asset")), 5)


@query("estimator_win_rates", "V15", """select h, winner, count(*) as wins, round(count(*)/sum(count(*)) over (partition by h),6) as win_rate
  from (select h, asset, arg_min(estimator, loss) as winner from aloss_w group by h, asset having count(loss)=2) group by h, winner""")
def _(spark, d):
    w = op.per_asset_winner(op.mean_loss(losses(spark, d), "qlike", ["h", "estimator", "asset"]), 2, ("h", "asset"))
    return rounded(op.win_rates(w, ("h",)))


@query("estimator_loss_by_sector", "V16", """with s as (select h, sector, estimator, avg(loss) as loss from aloss_w where loss is not null group by all)
select h, sector, round(max(loss) filter (where estimator='rv13'),5) as rv13, round(max(loss) filter (where estimator='rv26'),5) as rv26,
  arg_min(estimator, loss) as winner from s group by h, sector""")
def _(spark, d):
    x = op.mean_loss(losses(spark, d), "qlike", ["h", "estimator", "asset", "sector"]).where("loss is not null")
    s = x.groupBy("h", "sector", "estimator").agg(F.avg("loss").alias("loss"))
    return rounded(s.groupBy("h", "sector").agg(
        F.max(F.when(F.col("estimator") == "rv13", F.col("loss"))).alias("rv13"),
        F.max(F.when(F.col("estimator") == "rv26", F.col("loss"))).alias("rv26"),
        F.min_by("estimator", "loss").alias("winner")), 5)
