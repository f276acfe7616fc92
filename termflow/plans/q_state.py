"""Path-dependent estimators: EWMA, GARCH, Donchian, Kalman, cointegration, factor model."""

from termflow.functions.cols import rounded
from termflow.operators import factor, garch, state as op
from termflow.operators.signals import trend
from termflow.operators.xs import vol_targeted_sign
from termflow.plans.q_rv import pair_logs, registry
from termflow.plans.registry import cte, query
from termflow.sources import market as mk

cte("ret_n", "select asset, date, ret, close, row_number() over (partition by asset order by date) as t from ret_w")
A = "(1.0::double/13)"
cte("ewma_x", f"""select asset, cast(0 as bigint) as t, cast(null as double) as avg, 1.0::double as old from (select distinct asset from ret_n) union all
 select e.asset, n.t, case when n.ret is null then e.avg when e.avg is null then n.ret*n.ret else (e.old*e.avg+{A}*n.ret*n.ret)/(e.old+{A}) end,
  (case when n.ret is null then e.old else 1 end)*(case when e.avg is null and n.ret is null then 1 else 1-{A} end) from ewma_x e join ret_n n on n.asset=e.asset and n.t=e.t+1""")


@query("ewma_volatility", "V6", "select n.asset, n.date, round(sqrt(e.avg*52),6) as ewma_vol from ewma_x e join ret_n n on n.asset=e.asset and n.t=e.t")
def _(spark, d):
    return rounded(op.ewma_vol(mk.ret_w(spark, d), "ret", 12, 52))


@query("garch_walk_forward_vol", "V7")
def _(spark, d):
    return garch.walk_forward_vol(mk.ret_w(spark, d), "ret", 104, 20, 52)


cte("gv_n", "select asset, date, ret, row_number() over (partition by asset order by date) as t, count(*) over (partition by asset) as n from ret_w where ret is not null")
cte("gv_lr", "select asset, avg(ret*ret) as lr from gv_n where t<=104 and n>104 group by asset")
cte("gv_x", """select asset, cast(1 as bigint) as t, lr as s2 from gv_lr union all
 select g.asset, n.t+1, lr*(1-0.05-0.85-0.02)+(0.05+case when ret<0 then 0.04 else 0 end)*ret*ret+0.85*s2 from gv_x g join gv_n n on n.asset=g.asset and n.t=g.t join gv_lr l on l.asset=g.asset where n.t<n.n""")


@query("garch_filtered_vol", "V7", "select n.asset, n.date, round(sqrt(s2*52),6) as garch_vol from gv_x g join gv_n n on n.asset=g.asset and n.t=g.t where n.t>104")
def _(spark, d):
    return rounded(garch.filtered_vol(mk.ret_w(spark, d), "ret", (0.05, 0.04, 0.85), 104, 52))


def don_sql(a, b):
    return f"""select asset, date, close as p, '{a}/{b}' as system, row_number() over (partition by asset order by date) as t, case when count(close) over x={a} then max(close) over x end as eh, case when count(close) over x={a} then min(close) over x end as el,
  case when count(close) over y={b} then max(close) over y end as xh, case when count(close) over y={b} then min(close) over y end as xl from panel_w
  window x as (partition by asset order by date rows between {a} preceding and 1 preceding), y as (partition by asset order by date rows between {b} preceding and 1 preceding)"""


cte("don_n", don_sql(8, 4) + " union all " + don_sql(13, 6))
DON = "case when p is null or eh is null or el is null then st when st=0 and p>eh then 1 when st=0 and p<el then -1 when st>0 and p<xl then 0 when st<0 and p>xh then 0 else st end"
cte("don_x", f"""select distinct asset, system, cast(0 as bigint) as t, 0.0::double as st, cast(null as double) as outv from don_n union all
 select x.asset, x.system, n.t, {DON}, case when p is null or eh is null or el is null then null else {DON} end from don_x x join don_n n on n.asset=x.asset and n.system=x.system and n.t=x.t+1""")


@query("donchian_state_machine", "G7", "select n.asset, n.date, n.system, x.outv as state from don_x x join don_n n on n.asset=x.asset and n.system=x.system and n.t=x.t")
def _(spark, d):
    ch = trend.donchian_channels(mk.panel_w(spark, d), [8, 4, 13, 6])
    return op.donchian_states(ch, [(8, 4), (13, 6)]).select("asset", "date", "system", "state")


@query("breakout_signals", "G8", "select n.asset, n.date, n.system, round(0.4*sign(x.outv)/nullif(v.vol,0),6) as signal from don_x x join don_n n on n.asset=x.asset and n.system=x.system and n.t=x.t join vol_w v on v.asset=n.asset and v.date=n.date")
def _(spark, d):
    v = mk.vol_w(spark, d)
    st = op.donchian_states(trend.donchian_channels(v, [8, 4, 13, 6]), [(8, 4), (13, 6)])
    return rounded(st.join(v.select("asset", "date", "vol"), ["asset", "date"]).select("asset", "date", "system", vol_targeted_sign("state", "vol", 0.4).alias("signal")))


cte("kal_n", "select pair, date, ly, lx, row_number() over (partition by pair order by date) as t from pair_px where ly is not null and lx is not null")
V = "(0.0001::double/(1-0.0001::double))"
cte("kal_x", f"""select distinct pair, cast(0 as bigint) as t, 0.0::double as a, 0.0::double as b, 0.0::double as p11, 0.0::double as p12, 0.0::double as p22 from kal_n union all
 select pair, t, a+k1*e, b+k2*e, q11-k1*(q11+lx*q12), q12-k1*(q12+lx*q22), q22-k2*(q12+lx*q22) from (select *, (q11+lx*q12)/s as k1, (q12+lx*q22)/s as k2 from (
  select *, q11+2*lx*q12+lx*lx*q22+0.001::double as s from (select x.pair, n.t, x.a, x.b, n.lx, n.ly-x.a-x.b*n.lx as e, x.p11+{V} as q11, x.p12 as q12, x.p22+{V} as q22 from kal_x x join kal_n n on n.pair=x.pair and n.t=x.t+1)))""")


@query("kalman_hedge_ratio", "G30", "select n.pair, n.date, case when n.t>60 then round(x.a,4) end as alpha, case when n.t>60 then round(x.b,5) end as beta from kal_x x join kal_n n on n.pair=x.pair and n.t=x.t")
def _(spark, d):
    return rounded(op.kalman_hedge(pair_logs(spark, d), "ly", "lx"), 5, alpha=4)


@query("rolling_engle_granger", "G39")
def _(spark, d):
    return op.engle_granger(pair_logs(spark, d), "ly", "lx", 104, 26)


@query("cointegration_report", "G40", """select pair, leg_y, leg_x, case when n>=104 then 1+(n-104)//26 else 0 end as n_windows from pairs p left join (select pair as k, count(*) as n from kal_n group by 1) on k=pair""")
def _(spark, d):
    t = op.engle_granger(pair_logs(spark, d), "ly", "lx", 104, 26)
    return op.cointegration_report(t, registry(spark, d).select("pair", "leg_y", "leg_x")).drop("fraction")


@query("cointegration_rejection_share", "G40")
def _(spark, d):
    t = op.engle_granger(pair_logs(spark, d), "ly", "lx", 104, 26)
    return op.cointegration_report(t, registry(spark, d).select("pair", "leg_y", "leg_x"))


# The same test without lagged changes has a closed form; p by the published surface, its normal tail by Simpson's rule.
cte("eg_w", "select k.pair, k.w, n.t, n.date, n.ly, n.lx from (select pair, unnest(range((max(t)-104)//26+1)) as w from kal_n group by pair having max(t)>=104) k join kal_n n on n.pair=k.pair and n.t>26*k.w and n.t<=26*k.w+104")
cte("eg_b", "select pair, w, regr_slope(ly,lx) as b, regr_intercept(ly,lx) as a, max(date) as date from eg_w group by pair, w")
cte("eg_e", "select w.pair, w.w, ly-a-b*lx as e, lag(ly-a-b*lx) over (partition by w.pair, w.w order by t) as l from eg_w w join eg_b using (pair, w)")
cte("eg_t", """select pair, w, sxy/sxx/sqrt((syy-sxy*sxy/sxx)/(n-1)/sxx) as tau from (select pair, w, sum(l*(e-l)) as sxy, sum(l*l) as sxx, sum((e-l)*(e-l)) as syy, count(*) as n from eg_e where l is not null group by pair, w)""")
cte("eg_p", """select pair, w, tau, case when tau>0.92 then 1.0 when tau<-18.86 then 0.0 else 0.5-sign(z)*-1*list_sum([case when i=0 or i=200 then 1 when i%2=1 then 4 else 2 end*exp(-0.5*pow(abs(z)*i/200,2)) for i in range(201)])*abs(z)/600/sqrt(2*pi()) end as p from (
 select *, case when tau<=-2.62 then 2.92+1.5012*tau+0.039796*tau*tau else 2.1945+0.64695*tau-0.29198*tau*tau-0.042377*tau*tau*tau end as z from eg_t)""")


@query("engle_granger_no_lags", "G39", "select p.pair, b.date, round(tau,5) as stat, round(p,5) as pvalue from eg_p p join eg_b b on b.pair=p.pair and b.w=p.w")
def _(spark, d):
    return rounded(op.engle_granger(pair_logs(spark, d), "ly", "lx", 104, 26, lags=0), 5)


@query("cointegration_share_no_lags", "G40", "select s.pair, s.leg_y, s.leg_x, coalesce(n,0) as n_windows, round(f,6) as fraction from pairs s left join (select pair, count(*) as n, avg(case when p<0.05 then 1.0 else 0 end) as f from eg_p group by pair) e on e.pair=s.pair")
def _(spark, d):
    t = op.engle_granger(pair_logs(spark, d), "ly", "lx", 104, 26, lags=0)
    return rounded(op.cointegration_report(t, registry(spark, d).select("pair", "leg_y", "leg_x")))


CH = ["vol", "mom", "volume"]


def char_rank(c):
    return f"case when {c} is not null then rank() over (partition by date order by {c} nulls last)+(count({c}) over (partition by date, {c})-1)/2.0 end/count({c}) over (partition by date)-0.5"


cte("char_w", "select asset, date, r, unnest([{'l':'vol','z':vol},{'l':'mom','z':mom},{'l':'volume','z':volume},{'l':'const','z':1.0::double}], recursive:=true) from (select asset, date, lead(ret) over (partition by asset order by date) as r, "
    + ", ".join(f"{char_rank(c)} as {c}" for c in CH) + " from mom_w) where r is not null and vol is not null and mom is not null and volume is not null")


def chars(spark, d):
    return factor.characteristics(mk.mom_w(spark, d), CH)


@query("characteristic_panel", "G47", "select asset, date, l, round(z,6) as z, round(r,6) as r from char_w")
def _(spark, d):
    return rounded(chars(spark, d).select("asset", "date", "l", "z", "r"))


@query("managed_portfolios", "G44", "select date, l, round(sum(z*r),6) as x from char_w group by date, l")
def _(spark, d):
    return rounded(factor.managed_portfolios(chars(spark, d)))


@query("characteristic_products", "G44", "select a.date, a.l, b.l as m, round(sum(a.z*b.z),11) as zz from char_w a join char_w b on a.asset=b.asset and a.date=b.date group by all")
def _(spark, d):
    return rounded(factor.characteristic_products(chars(spark, d)), 11)


# First eigenvector by 300 power steps on the 4 x 4 second moment.
cte("xm", "select date, l, sum(z*r) as x from char_w group by date, l")
cte("sm", "select a.l, list(s order by b) as row from (select a.l, b.l as b, sum(a.x*b.x) as s from xm a join xm b on a.date=b.date group by a.l, b.l) a group by a.l")
cte("smat", "select list(row order by l) as m from sm")
cte("pw", """select 0 as k, [0.5,0.5,0.5,0.5]::double[] as v union all select k+1, list_transform(u, lambda c: c/sqrt(list_dot_product(u,u))) from (
  select k, list_transform(m, lambda r: list_dot_product(r, v)) as u from pw, smat where k<300)""")


@query("single_factor_r2", "G45", """select round(list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v)))/(m[1][1]+m[2][2]+m[3][3]+m[4][4]),5) as r2 from pw, smat where k=300""")
def _(spark, d):
    from termflow.session import materialize
    x = materialize(factor.managed_portfolios(chars(spark, d)), "portfolios")
    return rounded(factor.total_r2(factor.residuals(x, factor.loadings(x, 1))), 5)


# One factor: residuals of the power vector, then elimination on [mean Z'Z | mean d].
cte("an_g", "select unnest(['const','mom','vol','volume']) as l, unnest(v) as g from pw where k=300")
cte("an_d", "select x.date, x.l, x.x-g.g*f.f as d from xm x join an_g g using (l) join (select date, sum(x*g) as f from xm join an_g using (l) group by date) f on f.date=x.date")
cte("an_zz", "select l, m, avg(zz) as zz from (select a.date, a.l, b.l as m, sum(a.z*b.z) as zz from char_w a join char_w b on a.asset=b.asset and a.date=b.date group by all) group by l, m")
cte("an_m", "select list(row order by l) as m from (select z.l, list_append(list(zz order by m), max(d.d)) as row from an_zz z join (select l, avg(d) as d from an_d group by l) d on d.l=z.l group by z.l)")
cte("an_e", """select 0 as k, m from an_m union all select k+1, list_transform(m, lambda r, i: case when i=k+1 then list_transform(r, lambda v: v/r[k+1]) else list_transform(r, lambda v, c: v-r[k+1]*m[k+1][c]/m[k+1][k+1]) end) from an_e where k<4""")
cte("an_x", "select unnest(['const','mom','vol','volume']) as l, unnest(list_transform(m, lambda r: r[5])) as gamma from an_e where k=4")


def one_factor(spark, d):
    """(characteristics, anomaly loading) with one factor removed"""
    from termflow.session import materialize
    z = materialize(chars(spark, d), "chars")
    x = materialize(factor.managed_portfolios(z), "portfolios")
    return z, factor.anomaly_loading(factor.residuals(x, factor.loadings(x, 1)), factor.characteristic_products(z))


@query("anomaly_loading_one_factor", "G46", "select l, round(gamma,6) as gamma, round(sum(gamma*gamma) over (),6) as statistic from an_x")
def _(spark, d):
    from pyspark.sql import Window as W, functions as F
    g = one_factor(spark, d)[1]
    return rounded(g.withColumn("statistic", F.sum(F.col("gamma") * F.col("gamma")).over(W.partitionBy(F.lit(0)))))


@query("anomaly_signal_one_factor", "G46", "select asset, date, round(sum(z*gamma),6) as signal from char_w join an_x using (l) group by asset, date")
def _(spark, d):
    return rounded(factor.alpha_signal(*one_factor(spark, d)))


@query("anomaly_alpha_test", "G46")
def _(spark, d):
    from termflow.session import materialize
    z = materialize(chars(spark, d), "chars")
    x = factor.managed_portfolios(z)
    res = materialize(factor.residuals(x, factor.loadings(x, 2)), "residuals")
    zz = factor.characteristic_products(z)
    return factor.alpha_pvalue(factor.anomaly_loading(res, zz), factor.bootstrap_alpha(res, zz, 500))


@query("anomaly_alpha_signal", "G46")
def _(spark, d):
    from termflow.session import materialize
    z = materialize(chars(spark, d), "chars")
    x = factor.managed_portfolios(z)
    res = factor.residuals(x, factor.loadings(x, 2))
    return factor.alpha_signal(z, factor.anomaly_loading(res, factor.characteristic_products(z)))
