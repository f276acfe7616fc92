"""Covariance, correlation, tail risk, risk parity."""
from pyspark.sql import functions as F

from termflow.functions.cols import rounded
from termflow.operators import cov as op, garch, risk
from termflow.operators import backtest as bt
from termflow.plans.q_backtest import SPLIT, SPLITS_SQL, sector_streams
from termflow.plans.registry import cte, query
from termflow.session import materialize
from termflow.sources import driver_views as dv, market as mk

WIN, FRAC = 52, 0.3
cte("cal_n", "select date, row_number() over (order by date) as t from (select distinct date from bars_w)")
cte("reb_m", f"select max(t) as tr, arg_max(date, t) as rd from cal_n group by last_day(date) having max(t)>={WIN}")
cte("cwin", f"""select rd, p.asset, p.date, p.ret, count(p.ret) over (partition by rd, p.date) as k from reb_m join cal_n c on c.t between tr-{WIN - 1} and tr join ret_w p on p.date=c.date""")
cte("cfull", f"""select rd, asset, date, ret, ret-avg(ret) over (partition by rd, asset) as x, count(*) over (partition by rd, asset) as n from cwin where k=(select count(distinct asset) from bars_w)
  qualify count(*) over (partition by rd, asset)>={int(WIN * FRAC)}""")
cte("cpair", "select a.rd, a.asset as i, b.asset as j, any_value(a.n) as n, sum(a.x*b.x) as sxx from cfull a join cfull b on a.rd=b.rd and a.date=b.date group by 1,2,3")
cte("cstat", """select s.rd, s.n, s.p, s.mu, least((q.b-s.s2)/(s.n*s.p), (s.s2-s.p*s.mu*s.mu)/s.p) as beta, (s.s2-s.p*s.mu*s.mu)/s.p as delta from
 (select rd, any_value(n) as n, sqrt(count(*)) as p, sum(case when i=j then sxx/n else 0 end)/sqrt(count(*)) as mu, sum((sxx/n)**2) as s2 from cpair group by rd) s
 join (select rd, sum(v*v)/count(*) as b from (select rd, date, sum(x*x) as v from cfull group by rd, date) group by rd) q on s.rd=q.rd""")
cte("lw_x", """select c.rd, i, j, (1-w)*sxx/c.n+case when i=j then w*mu else 0 end as cov from cpair c join (select *, case when beta<=0 or delta<=0 then 0 else beta/delta end as w from cstat) s on c.rd=s.rd""")


def sample(spark, d):
    return op.sample_covariance(mk.ret_w(spark, d), window=WIN, min_frac=FRAC)


def shrunk(spark, d):
    return op.shrunk_covariance(mk.ret_w(spark, d), window=WIN, min_frac=FRAC)


@query("sample_covariance_rolling", "P2 P1", "select rd as rebalance_date, i, j, round(sxx/(n-1),4) as cov from cpair")
def _(spark, d):
    return rounded(sample(spark, d), 4)


@query("shrunk_covariance_rolling", "P3", "select rd as rebalance_date, i, j, round(cov,4) as cov from lw_x")
def _(spark, d):
    return rounded(shrunk(spark, d), 4)


cte("gwin", f"""select *, case when ret>=th then 1 when ret<=-th then -1 when ret is not null then 0 end as u from (select rd, asset, date, ret, 0.5*stddev_samp(ret) over (partition by rd, asset) as th from cwin
  qualify count(ret) over (partition by rd, asset)>={int(WIN * .7)})""")


@query("comovement_correlation", "P4 P6", """select a.rd as rebalance_date, a.asset as i, b.asset as j, case when a.asset=b.asset then 1 else round(greatest(-1,least(1,sum(a.u*b.u)/nullif(sum(case when a.u<>0 or b.u<>0 then 1 else 0 end),0))),6) end as cov
 from gwin a join gwin b on a.rd=b.rd and a.date=b.date where a.u is not null and b.u is not null group by a.rd, a.asset, b.asset""")
def _(spark, d):
    return rounded(op.gerber_correlation(mk.ret_w(spark, d), window=WIN))


@query("comovement_covariance", "P5 P6 F17")
def _(spark, d):
    return op.gerber_covariance(mk.ret_w(spark, d), window=WIN)


# Every fifth rebalance date one pair's cell is missing; such dates are dropped over all active assets.
cte("lw_holes", "select rd, i, j, case when month(rd)%5=0 and least(i,j)='NATION_1' and greatest(i,j)='NATION_3' then null else cov end as cov from lw_x")


# Before the eigenvalue repair the scaled scores are plain products; the deviations are those of the window.
cte("gsd", f"select rd, asset, stddev_samp(ret) as s from cwin group by rd, asset having count(ret)>={int(WIN * .7)}")


@query("comovement_covariance_unrepaired", "P5", """select g.rd as rebalance_date, g.i, g.j, round(g.c*a.s*b.s,4) as cov from (
 select a.rd, a.asset as i, b.asset as j, case when a.asset=b.asset then 1 else greatest(-1,least(1,sum(a.u*b.u)/nullif(sum(case when a.u<>0 or b.u<>0 then 1 else 0 end),0))) end as c
  from gwin a join gwin b on a.rd=b.rd and a.date=b.date where a.u is not null and b.u is not null group by a.rd, a.asset, b.asset) g join gsd a on a.rd=g.rd and a.asset=g.i join gsd b on b.rd=g.rd and b.asset=g.j""")
def _(spark, d):
    return rounded(op.gerber_covariance(mk.ret_w(spark, d), window=WIN, repair=False), 4)


@query("complete_matrix_dates", "F16", """select rd as rebalance_date, i, j, round(cov,4) as cov from lw_holes where rd not in (select rd from lw_holes where cov is null)""")
def _(spark, d):
    a = dv.table(spark, d, "nation").select(F.col("n_name").alias("asset"))
    hole = (F.month("rebalance_date") % 5 == 0) & (F.least("i", "j") == "NATION_1") & (F.greatest("i", "j") == "NATION_3")
    c = materialize(shrunk(spark, d).withColumn("cov", F.when(~hole, F.col("cov"))), "cov")
    return rounded(op.complete_dates(c, a), 4)


@query("complete_submatrix_elimination", "F17", """select a.rd as rebalance_date, a.asset as i, b.asset as j, case when a.asset=b.asset then 1 else round(greatest(-1,least(1,sum(a.u*b.u)/nullif(sum(case when a.u<>0 or b.u<>0 then 1 else 0 end),0))),6) end as cov
 from gwin a join gwin b on a.rd=b.rd and a.date=b.date where a.u is not null and b.u is not null and a.asset<>'NATION_4' and b.asset<>'NATION_4' group by a.rd, a.asset, b.asset""")
def _(spark, d):
    c = op.gerber_correlation(mk.ret_w(spark, d), window=WIN)
    return rounded(op.complete_submatrix(c.withColumn("cov", F.when((F.col("i") == F.col("j")) | ((F.col("i") != "NATION_4") & (F.col("j") != "NATION_4")), F.col("cov")))))


@query("implied_pair_correlation", "P15", "select c.rd as rebalance_date, c.i, c.j, round(c.cov/sqrt(a.cov*b.cov),6) as corr from lw_x c join lw_x a on a.rd=c.rd and a.i=c.i and a.j=c.i join lw_x b on b.rd=c.rd and b.i=c.j and b.j=c.j where c.i<c.j")
def _(spark, d):
    return rounded(op.implied_correlations(materialize(shrunk(spark, d), "cov")))


def estimators(r):
    return op.estimates(r, window=WIN, min_frac=FRAC, comovement_frac=0.7)


def min_variance_scores(spark, d):
    r = materialize(mk.ret_w(spark, d).select("asset", "date", "ret"), "returns")
    return op.forecast_accuracy(materialize(op.min_variance(estimators(r)), "minvar"), r)


@query("min_variance_forecast_test", "P14")
def _(spark, d):
    return min_variance_scores(spark, d)


@query("covariance_league_table", "P16")
def _(spark, d):
    return op.league_table(materialize(min_variance_scores(spark, d), "scores"))


# Minimum variance of the shrunk matrix and of its diagonal: elimination step by step on [S | 1], no pivoting as S is positive definite.
cte("mv_names", "select rd, list(i order by i) as names from (select distinct rd, i from lw_x) group by rd")
cte("mv_m", """select e.e as estimator, rd, list(row order by i) as m from (select rd, i, e, list_append(list(case when e='shrunk' or i=j then cov else 0 end order by j), 1.0::double) as row
  from lw_x cross join (values ('shrunk'),('diagonal')) t(e) group by rd, i, e) e group by e.e, rd""")
cte("mv_g", """select estimator, rd, 0 as k, m from mv_m union all
 select estimator, rd, k+1, list_transform(m, lambda r, i: case when i=k+1 then list_transform(r, lambda v: v/r[k+1]) else list_transform(r, lambda v, c: v-r[k+1]*m[k+1][c]/m[k+1][k+1]) end) from mv_g where k<len(m)""")
cte("mv_w", """select g.estimator, g.rd, unnest(n.names) as asset, unnest(list_transform(g.m, lambda r: r[len(r)]/t.s)) as w, 1/t.s as forecast_var from (select * from mv_g where k=len(m)) g join mv_names n on n.rd=g.rd
 join (select estimator, rd, list_sum(list_transform(m, lambda r: r[len(r)])) as s from mv_g where k=len(m)) t on t.estimator=g.estimator and t.rd=g.rd""")
cte("mv_next", "select estimator, rd, lead(rd) over (partition by estimator order by rd) as nx from (select distinct estimator, rd from mv_w)")
cte("mv_day", """select n.estimator, n.rd, p.date, sum(w.w*p.ret) as r, max(w.forecast_var) as fv from mv_next n join ret_w p on p.date>n.rd and p.date<=n.nx join mv_w w on w.estimator=n.estimator and w.rd=n.rd and w.asset=p.asset
 group by n.estimator, n.rd, p.date having count(*)=count(p.ret)""")
cte("mv_s", """select *, case when rv>0 and fv>0 then rv/fv-ln(rv/fv)-1 end as qlike from (select estimator, rd, max(fv) as fv, avg(r*r) as rv from mv_day group by estimator, rd)""")


def diagonal_scores(spark, d):
    r = materialize(mk.ret_w(spark, d).select("asset", "date", "ret"), "returns")
    c = materialize(op.shrunk_covariance(r, window=WIN, min_frac=FRAC), "shrunk")
    both = c.withColumn("estimator", F.lit("shrunk")).unionByName(c.withColumn("cov", F.when(F.col("i") == F.col("j"), F.col("cov")).otherwise(0.0)).withColumn("estimator", F.lit("diagonal")))
    return materialize(op.forecast_accuracy(materialize(op.min_variance(both), "minvar"), r), "scores")


@query("min_variance_shrunk_and_diagonal", "P14", "select estimator, rd as rebalance_date, round(fv,6) as forecast_var, round(rv,6) as realized_var, round(qlike,4) as qlike from mv_s")
def _(spark, d):
    return rounded(diagonal_scores(spark, d).drop("condition"), 6, qlike=4)


@query("covariance_league_of_two", "P16", """with c as (select * from mv_s where qlike is not null and rd in (select rd from mv_s where qlike is not null group by rd having count(*)=2)),
 w as (select rd, arg_min(estimator, qlike) as e from c group by rd)
select c.estimator, round(avg(qlike),4) as mean_loss, count(*) as n, round(count(*) filter (where w.e=c.estimator)/count(*),5) as win_rate from c join w using (rd) group by c.estimator""")
def _(spark, d):
    return rounded(op.league_table(diagonal_scores(spark, d)), 4, win_rate=5)


# ---- streams: one damped return series per sector


def streams(spark, d):
    return sector_streams(spark, d).select(F.col("sector").alias("stream"), "date", F.col("r").alias("pnl"))


cte("st", "select sector as stream, date, r as pnl from sec_w")
cte("stp", "select x.stream as a, y.stream as b, x.date, x.pnl as xa, y.pnl as xb, row_number() over (partition by x.stream, y.stream order by x.date) as t from st x join st y on x.date=y.date and x.stream<y.stream")
cte("stc", """select a, b, date, case when count(xa) over w=26 and stddev_samp(xa) over w>1e-9 and stddev_samp(xb) over w>1e-9 then covar_samp(xa,xb) over w/(stddev_samp(xa) over w*stddev_samp(xb) over w) end as corr from stp
  window w as (partition by a, b order by date rows between 25 preceding and current row)""")


def stream_corr(spark, d):
    return risk.rolling_correlation(risk.stream_pairs(streams(spark, d)), 26).select("a", "b", "date", "corr")


@query("aligned_stream_pairs", "J17", "select a, b, date, round(xa,6) as xa, round(xb,6) as xb from stp")
def _(spark, d):
    return rounded(risk.stream_pairs(streams(spark, d)))


@query("rolling_stream_correlation", "P9", "select a, b, date, round(corr,5) as corr from stc")
def _(spark, d):
    return rounded(stream_corr(spark, d), 5)


DEC = "(1-exp(-ln(2.0::double)/13))"
cte("ewc", f"""select a, b, t, xa*xb as c, xa*xa as va, xb*xb as vb from stp where t=1 union all select e.a, e.b, p.t, e.c+{DEC}*(xa*xb-e.c), e.va+{DEC}*(xa*xa-e.va), e.vb+{DEC}*(xb*xb-e.vb) from ewc e join stp p on p.a=e.a and p.b=e.b and p.t=e.t+1""")


@query("ewma_stream_correlation", "P10", "select e.a, e.b, p.date, case when va*vb>0 then round(c/sqrt(va*vb),5) end as corr from ewc e join stp p on p.a=e.a and p.b=e.b and p.t=e.t")
def _(spark, d):
    return rounded(risk.ewma_correlation(risk.stream_pairs(streams(spark, d)), 13), 5)


@query("correlation_summary", "P11 P12", "select a, b, count(corr) as n, round(avg(corr),5) as mean, round(stddev_samp(corr),5) as std, round(min(corr),5) as min, round(max(corr),5) as max, round(avg(case when corr<0 then 1.0 when corr>=0 then 0 end),5) as pct_negative from stc group by a, b")
def _(spark, d):
    return rounded(risk.correlation_summary(stream_corr(spark, d)), 5)


@query("stress_window_correlation", "P12", """select a, b, w as "window", round(avg(corr),5) as mean, count(corr) as n from stc join (values ('first', date '1997-01-01', date '1998-12-31'), ('second', date '1998-06-01', date '2000-06-30')) t(w, s, e) on date between s and e group by 1,2,3""")
def _(spark, d):
    r = dv.table(spark, d, "region").where("r_regionkey < 2")
    first = F.col("r_regionkey") == 0
    win = r.select(F.when(first, "first").otherwise("second").alias("window"), F.when(first, F.to_date(F.lit("1997-01-01"))).otherwise(F.to_date(F.lit("1998-06-01"))).alias("start"),
                   F.when(first, F.to_date(F.lit("1998-12-31"))).otherwise(F.to_date(F.lit("2000-06-30"))).alias("end"))
    return rounded(risk.stress_means(stream_corr(spark, d), win), 5)


cte("last63", "select * from (select *, row_number() over (partition by stream order by date desc) as k from st) where k<=63")


@query("sleeve_sample_covariance", "P7", "select x.stream as i, y.stream as j, round(covar_samp(x.pnl,y.pnl),8) as cov from last63 x join last63 y on x.date=y.date group by 1,2")
def _(spark, d):
    return rounded(risk.sleeve_covariance(streams(spark, d), 5), 8)


cte("wst", "select *, pow(exp(-ln(2.0::double)/26), k-1) as w from (select *, row_number() over (partition by stream order by date desc) as k from st)")
cte("ewcov", """select i, j, (sxy/w-sx*sy/(w*w))*w*w/(w*w-w2) as cov from (select x.stream as i, y.stream as j, sum(x.w) as w, sum(x.w*x.w) as w2, sum(x.w*x.pnl) as sx, sum(x.w*y.pnl) as sy, sum(x.w*x.pnl*y.pnl) as sxy from wst x join wst y on x.date=y.date group by 1,2)""")


@query("sleeve_ewma_covariance", "P7", "select i, j, round(cov,8) as cov from ewcov")
def _(spark, d):
    return rounded(risk.sleeve_ewma_covariance(streams(spark, d), 5), 8)


@query("dynamic_conditional_correlation", "P8")
def _(spark, d):
    s = streams(spark, d)
    other = s.select(F.col("stream").alias("other"), "date", F.col("pnl").alias("pnl2"))
    pairs = s.join(other, "date").where("stream < other").withColumn("set_id", F.concat_ws("+", "stream", "other"))
    legs = F.array(F.struct("stream", "pnl"), F.struct(F.col("other").alias("stream"), F.col("pnl2").alias("pnl")))
    return garch.dcc_path(pairs.select("set_id", "date", F.inline(legs)))


# The recursions with given parameters: variances per stream and pair, then the correlation around its unconditional level.
cte("dc_lr", "select a, b, avg(xa*xa) as la, avg(xb*xb) as lb from stp group by a, b")
cte("dc_v", """select p.a, p.b, p.t, la as va, lb as vb, xa, xb from stp p join dc_lr using (a, b) where t=1 union all
 select p.a, p.b, p.t, la*(1-0.05-0.85-0.02)+(0.05+case when v.xa<0 then 0.04 else 0 end)*v.xa*v.xa+0.85*v.va, lb*(1-0.05-0.85-0.02)+(0.05+case when v.xb<0 then 0.04 else 0 end)*v.xb*v.xb+0.85*v.vb, p.xa, p.xb
 from dc_v v join stp p on p.a=v.a and p.b=v.b and p.t=v.t+1 join dc_lr l on l.a=v.a and l.b=v.b""")
cte("dc_z", "select *, xa/sqrt(va) as za, xb/sqrt(vb) as zb from dc_v")
cte("dc_bar", "select a, b, covar_samp(za,zb)/(stddev_samp(za)*stddev_samp(zb)) as q from dc_z group by a, b")
cte("dc_q", """select z.a, z.b, z.t, 1.0::double as qa, 1.0::double as qb, q as qc from dc_z z join dc_bar using (a, b) where t=1 union all
 select d.a, d.b, z.t+1, 0.05+0.03*za*za+0.92*qa, 0.05+0.03*zb*zb+0.92*qb, 0.05*r.q+0.03*za*zb+0.92*qc from dc_q d join dc_z z on z.a=d.a and z.b=d.b and z.t=d.t join dc_bar r on r.a=d.a and r.b=d.b
 where z.t<(select max(t) from stp m where m.a=d.a and m.b=d.b)""")


@query("conditional_correlation_given", "P8", "select q.a || '+' || q.b as set_id, p.date, round(qc/sqrt(qa*qb),5) as corr, round(qc/sqrt(qa*qb)*sqrt(va*vb),8) as cov from dc_q q join dc_v v on v.a=q.a and v.b=q.b and v.t=q.t join stp p on p.a=q.a and p.b=q.b and p.t=q.t")
def _(spark, d):
    s = materialize(streams(spark, d), "streams")
    other = s.select(F.col("stream").alias("other"), "date", F.col("pnl").alias("pnl2"))
    pairs = s.join(other, "date").where("stream < other").withColumn("set_id", F.concat_ws("+", "stream", "other"))
    legs = F.array(F.struct("stream", "pnl"), F.struct(F.col("other").alias("stream"), F.col("pnl2").alias("pnl")))
    c = garch.dcc_path(pairs.select("set_id", "date", F.inline(legs)), volatility=(0.05, 0.04, 0.85), dynamics=(0.03, 0.92))
    return rounded(c.where("i < j").select("set_id", "date", "corr", "cov"), 5, cov=8)


@query("historical_tail_risk", "P17", """select s.stream, round(v,6) as "var", round(avg(pnl) filter (where pnl<=v),6) as es from st s join (select stream, quantile_cont(pnl,0.05) as v from st group by stream) q on s.stream=q.stream group by s.stream, v""")
def _(spark, d):
    return rounded(risk.historical_tail(streams(spark, d), ["stream"]))


@query("expanding_tail_risk", "P18",
    """select stream, date, case when n>=24 then round(v,6) end as "var", case when n>=24 then round(list_avg(list_filter(l, lambda p: p<=v)),6) end as es from (select x.stream, x.date, count(*) as n, quantile_cont(y.pnl,0.05) as v, list(y.pnl) as l
 from st x join st y on y.stream=x.stream and y.date<=x.date group by x.stream, x.date)""")
def _(spark, d):
    return rounded(risk.expanding_tail(streams(spark, d), "stream"))


# Pairs of sectors as two-sleeve sets have the closed form w ~ 1/sigma.
cte("twoset", "select x.i || '+' || y.i as set_id, x.i as a, y.i as b, sqrt(x.cov) as sa, sqrt(y.cov) as sb from ewcov x join ewcov y on x.i<y.i where x.i=x.j and y.i=y.j")


def two_sets(spark, d):
    """Every two-sector set's 2 x 2 covariance, long."""
    c = materialize(risk.sleeve_ewma_covariance(streams(spark, d), 5), "sleeve-cov")
    names = c.where("i = j").select("i")
    sets = c.where("i < j").select(F.concat_ws("+", "i", "j").alias("set_id"), F.explode(F.array(
        F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")), F.struct("i", F.col("i").alias("j")), F.struct(F.col("j").alias("i"), "j"))).alias("e"))
    return sets.select("set_id", "e.i", "e.j").join(c, ["i", "j"]).join(names, "i", "left_semi").select("set_id", "i", "j", "cov")


@query("risk_parity_two_sleeves", "P20", "select set_id, a as i, round(sb/(sa+sb),6) as w from twoset union all select set_id, b, round(sa/(sa+sb),6) from twoset")
def _(spark, d):
    return rounded(risk.risk_parity(two_sets(spark, d)).where("converged").drop("converged"))


@query("risk_parity_contribution_shares", "P19 P20", "select 'all' as set_id, stream as i, 0.2::double as share from (select distinct stream from st)")
def _(spark, d):
    c = materialize(risk.sleeve_ewma_covariance(streams(spark, d), 5).withColumn("set_id", F.lit("all")), "sleeve-cov")
    return rounded(risk.risk_contributions(risk.risk_parity(c), c).select("set_id", "i", "share"), 5)


@query("risk_contributions_equal_weight", "P19", "select i, round(0.04*sum(cov),8) as rc, round(sum(cov)/(select sum(cov) from ewcov),6) as share from ewcov group by i")
def _(spark, d):
    c = risk.sleeve_ewma_covariance(streams(spark, d), 5).withColumn("set_id", F.lit("all"))
    w = c.where("i = j").select("set_id", "i", F.lit(0.2).alias("w"))
    return rounded(risk.risk_contributions(w, c).select("i", "rc", "share"), 6, rc=8)


@query("leverage_grid_selection", "P21 P20", f"""with g as (select l, date, sum(case when stream='ASIA' then l*pnl else (1-l)*pnl end) as pnl from st cross join (values (0.25),(0.5),(0.75)) t(l) where stream in ('ASIA','EUROPE') group by 1,2),
t as (select *, {SPLIT} as split from g), k as (select *, row_number() over (partition by l, split order by date) as k from t),
s as (select l, {SPLITS_SQL} from k where split='train' or k>1 or (split='validation' and exists (select 1 from pnl_w where date=date '1999-12-31')) or (split='test' and exists (select 1 from pnl_w where date=date '2000-12-31')) group by l)
select arg_max(l::double, validation) as leverage, max(validation) as validation, arg_max(test, validation) as test from s""")
def _(spark, d):
    s = streams(spark, d).where("stream in ('ASIA', 'EUROPE')")
    g = s.withColumn("l", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    g = g.groupBy("l", "date").agg(F.sum(F.when(F.col("stream") == "ASIA", F.col("l") * F.col("pnl")).otherwise((1 - F.col("l")) * F.col("pnl"))).alias("pnl"))
    t = rounded(bt.sharpe_by_split(bt.split_tag(g, "1999-12-31", "2000-12-31", ("l",)), ["l"], ppy=52), 5)
    return t.agg(F.max_by("l", "validation").alias("leverage"), F.max("validation").alias("validation"), F.max_by("test", "validation").alias("test"))
