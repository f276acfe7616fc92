"""Pairs: hedge ratios, spreads, bands, error correction."""
from pyspark.sql import Window as W, functions as F

from termflow.functions.cols import rounded
from termflow.operators.signals import relative_value as op
from termflow.plans.registry import cte, query
from termflow.sources import driver_views as dv, market as mk

cte("pairs", """select sector || '_' || i as pair, leg_y, leg_x, case when i%2=1 then 'ratio' else 'hedge' end as grp from (select sector, asset as leg_y, lead(asset) over w as leg_x, row_number() over w as i
  from (select distinct asset, sector from bars_w) window w as (partition by sector order by asset)) where leg_x is not null""")
cte("pair_px", """select pair, leg_y, leg_x, grp, y.date, ln(y.close) as ly, ln(x.close) as lx from pairs join panel_w y on y.asset=leg_y join panel_w x on x.asset=leg_x and x.date=y.date""")
cte("pair_beta", """select *, case when count(case when ly is not null then lx end) over w>=36 then covar_samp(ly,lx) over w end / nullif(case when count(lx) over w>=36 then var_samp(lx) over w end,0) as beta from pair_px
  window w as (partition by pair order by date rows between 51 preceding and current row)""")
cte("spread_w", "select pair, date, ly, lx, grp, ly-case when grp='ratio' then 1 else beta end*lx as spread from pair_beta")
cte("pair_z", """select *, (spread-case when count(spread) over w>=18 then avg(spread) over w end)/nullif(case when count(spread) over w>=18 then stddev_samp(spread) over w end,0) as z,
  case when count(chg) over w>=13 then stddev_samp(chg) over w*sqrt(52) end as vol from (select *, spread-lag(spread) over (partition by pair order by date) as chg from spread_w)
  window w as (partition by pair order by date rows between 25 preceding and current row)""")


def registry(spark, d):
    """Neighbouring assets of each sector; odd pairs use a fixed ratio, even pairs an estimated one."""
    a = dv.assets(spark, d).select("asset", "sector").join(dv.bars_w(spark, d).select("asset").distinct(), "asset", "left_semi").distinct()
    w = W.partitionBy("sector").orderBy("asset")
    r = a.select("sector", F.col("asset").alias("leg_y"), F.lead("asset").over(w).alias("leg_x"), F.row_number().over(w).alias("i"))
    return r.where("leg_x is not null").select(F.concat_ws("_", "sector", "i").alias("pair"), "leg_y", "leg_x",
                                               F.when(F.col("i") % 2 == 1, "ratio").otherwise("hedge").alias("grp"))


def pair_logs(spark, d):
    p = op.pair_prices(mk.panel_w(spark, d), registry(spark, d))
    return p.select("pair", "leg_y", "leg_x", "grp", "date", F.ln("py").alias("ly"), F.ln("px").alias("lx"))


def spreads(spark, d):
    p = pair_logs(spark, d).withColumn("beta", op.ols_beta("ly", "lx", 52))
    b = F.when(F.col("grp") == "ratio", F.lit(1.0)).otherwise(F.col("beta"))
    return p.withColumn("spread", F.col("ly") - b * F.col("lx")).select("pair", "date", "ly", "lx", "grp", "spread")


@query("rolling_hedge_ratio", "G29", "select pair, date, round(beta,6) as beta from pair_beta")
def _(spark, d):
    return rounded(pair_logs(spark, d).select("pair", "date", op.ols_beta("ly", "lx", 52).alias("beta")))


@query("log_ratio_spread", "G31 G33 G37", "select pair, date, round(spread,6) as spread, round(spread-lag(spread) over (partition by pair order by date),6) as change from spread_w")
def _(spark, d):
    return rounded(spreads(spark, d).select("pair", "date", "spread", op.spread_change("spread").alias("change")))


@query("crack_spread_level", "G32", """select date, round((2*42*max(close) filter (where asset='NATION_5')+42*max(close) filter (where asset='NATION_10'))/3-max(close) filter (where asset='NATION_0'),4) as spread from panel_w group by date""")
def _(spark, d):
    return rounded(op.crack_level(mk.panel_w(spark, d), "NATION_5", "NATION_10", "NATION_0"), 4)


@query("spread_zscore", "G34", "select pair, date, round(z,6) as z from pair_z")
def _(spark, d):
    return rounded(spreads(spark, d).select("pair", "date", op.zscore("spread", 26).alias("z")))


@query("spread_continuous_signal", "G35 V8", "select pair, date, round(-z/nullif(vol,0),6) as continuous from pair_z")
def _(spark, d):
    return rounded(op.pair_signals(spreads(spark, d), 26, 26, ppy=52).select("pair", "date", "continuous"))


cte("pair_n", "select *, row_number() over (partition by pair order by date) as t from pair_z")
cte("band_x", """select pair, cast(0 as bigint) as t, cast(0 as double) as st, cast(null as double) as outv from (select distinct pair from pair_n)
 union all select b.pair, n.t, case when z is null then st when st=0 and z>1.5 then -1 when st=0 and z<-1.5 then 1 when st<>0 and abs(z)<0.5 then 0 else st end,
  case when z is null then null when st=0 and z>1.5 then -1 when st=0 and z<-1.5 then 1 when st<>0 and abs(z)<0.5 then 0 else st end
 from band_x b join pair_n n on n.pair=b.pair and n.t=b.t+1""")


@query("threshold_band_state", "G36", "select n.pair, n.date, b.outv as state from band_x b join pair_n n on b.pair=n.pair and b.t=n.t")
def _(spark, d):
    x = spreads(spark, d).withColumn("z", op.zscore("spread", 26))
    return op.threshold_band(x, "z", 1.5, 0.5).select("pair", "date", "state")


@query("pair_signal_specs", "G37", """select n.pair, n.date, round(-z/nullif(vol,0),6) as continuous, round(sign(b.outv)/nullif(vol,0),6) as threshold from band_x b join pair_n n on b.pair=n.pair and b.t=n.t""")
def _(spark, d):
    return rounded(op.pair_signals(spreads(spark, d), 26, 26, entry=1.5, ppy=52).select("pair", "date", "continuous", "threshold"))


@query("policy_basis", "G38", """select asset, date, round(100-close/1000-rate,6) as basis, round(case when count(b) over w>=18 then (b-avg(b) over w)/stddev_samp(b) over w end,5) as z from (
 select *, 100-close/1000-rate as b from (select p.asset, p.date, p.close, last_value(v.close ignore nulls) over (partition by asset order by p.date) as rate from panel_w p left join vix_w v on p.date=v.date))
 window w as (partition by asset order by date rows between 25 preceding and current row)""")
def _(spark, d):
    px = mk.panel_w(spark, d).select("asset", "date", (F.col("close") / 1000).alias("close"))
    b = op.policy_basis(px, dv.vix(spark, d).withColumnRenamed("close", "rate"))
    return rounded(b.select("asset", "date", "basis", op.zscore("basis", 26, "asset").alias("z")), 6, z=5)


cte("ecm_rows", """select *, lag(d) over (partition by pair order by date) as d1 from (select pair, date, spread, lag(spread) over w as l, spread-lag(spread) over w as d,
  row_number() over w as rn from spread_w where spread is not null window w as (partition by pair order by date))""")


def ecm(over):
    c = {k: f"{f}({a}) filter (where d1 is not null) {over}" for k, f, a in (
        ("dl", "covar_samp", "d,l"), ("dk", "covar_samp", "d,d1"), ("lk", "covar_samp", "l,d1"), ("vl", "var_samp", "l"), ("vk", "var_samp", "d1"))}
    return f"({c['dl']}*{c['vk']}-{c['dk']}*{c['lk']})/({c['vl']}*{c['vk']}-{c['lk']}*{c['lk']})"


cte("ecm_roll", f"""select pair, date, case when n>=30 then lam end as lam, n from (select pair, date, rn, {ecm('over w')} as lam, count(d1) over w as n from ecm_rows
 window w as (partition by pair order by date rows between 49 preceding and current row)) where rn>=52 and (rn-52)%13=0""")


@query("error_correction_half_life", "G41 G42", f"""select pair, round(lam,6) as "lambda", round(case when lam<0 then -ln(2)/lam end,5) as half_life, n as n_obs from (select pair, {ecm('')} as lam, count(d1) as n from ecm_rows where date<=date '1999-12-31' group by pair)""")
def _(spark, d):
    return rounded(op.full_half_life(spreads(spark, d), "1999-12-31"), 6, half_life=5)


@query("rolling_half_life", "G42", """select pair, date, round(lam,6) as "lambda", round(case when lam<0 then -ln(2)/lam end,5) as half_life, n as n_obs from ecm_roll""")
def _(spark, d):
    return rounded(op.rolling_half_life(spreads(spark, d), window=52, step=13), 6, half_life=5)


@query("half_life_window", "G42 G43", """select pair, round(h,5) as half_life, case when h>0 then cast(least(greatest(round_even(2*h,0),2),252) as integer) else 63 end as z_window from (
 select pair, median(case when lam<0 then -ln(2)/lam end) as h from ecm_roll where date<=date '2000-12-31' group by pair)""")
def _(spark, d):
    m = op.median_half_life(op.rolling_half_life(spreads(spark, d), window=52, step=13), "2000-12-31")
    return rounded(m.withColumn("z_window", op.half_life_window("half_life", lo=2, fallback=63)), 5)
