"""Books, allocator and attribution on sector universes."""
from pyspark.sql import functions as F

from termflow.functions.cols import rounded
from termflow.operators import asof, backtest as bt, book as op, cov as cv
from termflow.plans.q_backtest import SPLIT, SPLITS_SQL
from termflow.plans.q_tables import regime_acts
from termflow.plans.registry import cte, query
from termflow.session import materialize
from termflow.sources import driver_views as dv, market as mk

BASE = dict(gamma=1.0, kappa=0.5, max_weight=0.30, target_vol=0.10, halflife=26.0)
POINTS = [dict(BASE, point="base"), dict(BASE, point="taxed", lambd=0.002, gamma=2.0), dict(BASE, point="neutral", neutral=True)]

# One book per sector, diagonal risk, so each solve is elementwise and the walk is one recursion.
cte("bk_n", "select sector as book, count(distinct asset) as n from bars_w group by sector")
cte("bk_rows", """select book, date, row_number() over (partition by book order by date) as t, a, s, assets from (select s.sector as book, date, list(signal order by asset) as a, list(vol*vol/52 order by asset) as s, list(asset order by asset) as assets, count(signal) as k, count(vol) as kv
  from (select distinct * from sig_w) s group by s.sector, date) x join bk_n using (book) where k=n and kv=n""")
cte("bk_next", "select book, date, t, lead(date) over (partition by book order by date) as next from bk_rows")
cte("bk_pr", """select b.book, b.date, b.t, r.asset, case when b.next-b.date>60 then 0 else coalesce(sum(r.ret),0) end as pr from bk_next b join ret_w r on r.sector=b.book and r.date>b.date and r.date<=b.next group by b.book, b.date, b.t, r.asset, b.next""")
cte("bk_prl", "select book, t, list(pr order by asset) as pr from bk_pr group by book, t")
PTS = "(values ('base',1.0::double,0.0::double,false),('taxed',2.0,0.002,false),('neutral',1.0,0.0,true)) p(point, g, l, neutral)"
D = "(1-exp(-ln(2.0::double)/26))"
cte("bk_x", f"""select r.book, p.point, p.g, p.l, p.neutral, cast(0 as bigint) as t, list_transform(r.a, lambda v: 0.0::double) as x, 0.01::double/52 as va, 1.0::double as scale, false as cap_bound from bk_rows r, {PTS} where r.t=1
 union all select book, point, g, l, neutral, t, case when neutral then list_transform(y, lambda v: v-list_avg(y)) else y end, va, scale, cap_bound from (
  select *, list_transform(x3, lambda v: greatest(-0.3,least(0.3,v*scale))) as y from (select *, case when rv>1e-8 then greatest(0.1,least(5,least((0.1/rv)**2, cap))) else 1 end as scale, rv>1e-8 and cap<(0.1/rv)**2 as cap_bound from (
   select *, sqrt(greatest(va,0)*52) as rv, case when list_max(list_transform(x3, lambda v: abs(v)))>0 then 0.3/list_max(list_transform(x3, lambda v: abs(v))) else 1e300 end as cap from (
    select *, list_transform(case when neutral then list_transform(x1, lambda v: v-list_avg(x1)) else x1 end, lambda v: greatest(-0.3,least(0.3,v))) as x3 from (
     select b.book, b.point, b.g, b.l, b.neutral, r.t, list_transform(r.a, lambda v, i: (v+0.5*b.x[i]-b.l*sign(b.x[i]))/(b.g*r.s[i]+0.5)) as x1,
      case when q.pr is null then b.va else (1-{D})*b.va+{D}*list_dot_product(b.x, q.pr)**2 end as va from bk_x b join bk_rows r on r.book=b.book and r.t=b.t+1 left join bk_prl q on q.book=b.book and q.t=b.t)))))""")
cte("bk_w", "select x.book, x.point, r.date, x.t, unnest(r.assets) as asset, unnest(x.x) as w, x.scale, x.cap_bound from bk_x x join bk_rows r on r.book=x.book and r.t=x.t")
cte("bk_c", "select w.*, p.pr, w.w*p.pr as contribution, abs(w.w-lag(w.w) over (partition by w.book, w.point, w.asset order by w.date)) as tr from bk_w w join bk_pr p on p.book=w.book and p.t=w.t and p.asset=w.asset")
cte("bk_pnl", """select book, point, date, sum(contribution) as gross, coalesce(sum(tr),0) as turnover, case point when 'taxed' then 0.002 else 0 end*coalesce(sum(tr),0) as penalty, coalesce(sum(tr*cost_bps/10000),0) as cost from bk_c c left join cost_w k on k.asset=c.asset group by 1,2,3""")


def base(spark, d):
    """The signal panel, written once: alphas, variances and returns all read it."""
    return materialize(mk.sig_w(spark, d).select("asset", "sector", "date", "ret", "vol", "signal"), "signal-panel")


def alphas(p):
    return p.select(F.col("sector").alias("book"), "asset", "date", F.col("signal").alias("alpha"))


def diagonal(p):
    """Within-sector pair table with variances on the diagonal."""
    v = p.where("vol is not null").select("sector", F.col("date").alias("rebalance_date"), F.col("asset").alias("i"), (F.col("vol") * F.col("vol") / 52).alias("v"))
    j = v.select("sector", "rebalance_date", F.col("i").alias("j"))
    return v.join(j, ["sector", "rebalance_date"]).select("rebalance_date", "i", "j", F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0).alias("cov"))


def inputs(p):
    return materialize(op.book_inputs(alphas(p), diagonal(p), p), "book-inputs")


def walked(spark, d, points=POINTS):
    """(panel, points, weights, period returns); the walk is written once and reused."""
    p = base(spark, d)
    x = inputs(p)
    pts = op.grid(x, points)
    w = materialize(op.run_books(x, pts), "book-weights")
    return p, pts, w, op.period_returns(p, x.select("book", "date"))


def costs(spark, d):
    return bt.tiered_cost_bps(dv.bars_w(spark, d), "1999-01-01").drop("adv")


@query("period_returns_between_rebalances", "O5", "select book, date, asset, round(pr,6) as pr from bk_pr")
def _(spark, d):
    p = base(spark, d)
    pr = op.period_returns(p, inputs(p).select("book", "date"))
    mine = dv.assets(spark, d).select(F.col("sector").alias("book"), "asset").distinct()
    return rounded(pr.join(mine, ["book", "asset"], "left_semi").select("book", "date", "asset", "pr"))


HOLE = "date between date '2000-02-01' and date '2000-05-31'"
cte("bk_holes", f"select book, date, lead(date) over (partition by book order by date) as next from bk_rows where not ({HOLE})")


@query("stale_rebalance_gaps", "O5", """select h.book, n_dates, n_stale_gaps, round(p.idle,6) as idle from (select book, count(*) as n_dates, count(*) filter (where next-date>60) as n_stale_gaps from bk_holes group by book) h
 join (select b.book, sum(abs(case when b.next-b.date>60 then 0 else r.ret end)) as idle from bk_holes b join ret_w r on r.sector=b.book and r.date>b.date and r.date<=b.next where b.next-b.date>60 group by b.book) p on p.book=h.book""")
def _(spark, d):
    """Four months without a rebalance: one stale gap per book, which earns nothing."""
    p = base(spark, d)
    reb = materialize(inputs(p).where(f"not ({HOLE})").select("book", "date"), "holed-dates")
    pr = op.period_returns(p, reb).join(dv.assets(spark, d).select(F.col("sector").alias("book"), "asset").distinct(), ["book", "asset"], "left_semi")
    idle = pr.where("date = (date '2000-01-28')").groupBy("book").agg(F.sum(F.abs("pr")).alias("idle"))
    return rounded(op.stale_gaps(reb).join(idle, "book"))


@query("book_walk_weights", "O1 O2 O3 O4", "select book, point, date, asset, round(w,6) as w, round(scale,5) as scale, cap_bound from bk_w")
def _(spark, d):
    x = inputs(base(spark, d))
    return rounded(op.run_books(x, op.grid(x, POINTS)), 6, scale=5)


@query("book_pnl", "O6", "select book, point, date, round(gross,6) as gross, round(turnover,6) as turnover, round(penalty,8) as penalty, round(cost,8) as cost, round(gross-penalty-cost,6) as pnl from bk_pnl")
def _(spark, d):
    _, pts, w, pr = walked(spark, d)
    return rounded(op.book_pnl(w, pr, pts, costs(spark, d)), 6, penalty=8, cost=8)


cte("bk_mark", """select g.book, g.point, g.date, coalesce(sum(g.h*r.ret),0)-coalesce(max(k.c),0) as pnl from (select book, point, asset, date, lag(held) over (partition by book, point, asset order by date) as h from (
  select a.book, a.point, a.asset, c.date, last_value(w.w ignore nulls) over (partition by a.book, a.point, a.asset order by c.date) as held from (select distinct book, point, asset from bk_w) a cross join cal_n c left join bk_w w on w.book=a.book and w.point=a.point and w.asset=a.asset and w.date=c.date)) g
  left join ret_w r on r.asset=g.asset and r.date=g.date left join (select book, point, date, sum(dw*cost_bps/10000) as c from (select *, abs(w-lag(w) over (partition by book, point, asset order by date)) as dw from bk_w) w left join cost_w k on k.asset=w.asset group by 1,2,3) k on k.book=g.book and k.point=g.point and k.date=g.date
  group by g.book, g.point, g.date""")


@query("daily_marked_weight_path", "O7 T6", "select book, point, date, round(pnl,6) as pnl from bk_mark")
def _(spark, d):
    panel, _, w, _ = walked(spark, d)
    return rounded(op.daily_mark(w, panel, cost_bps=costs(spark, d)))


@query("allocator_combined_pnl", "O8 J16", "select point, date, round(sum(case book when 'ASIA' then 0.5 else 1 end*(gross-penalty-cost)),6) as pnl from bk_pnl group by point, date")
def _(spark, d):
    _, pts, w, pr = walked(spark, d)
    return rounded(op.allocate(op.book_pnl(w, pr, pts, costs(spark, d)), {"ASIA": 0.5}, by=("point", "date")))


def walk_sql(rows, prl, ppy=52, hl=26):
    """Recursion of one base-point walk over rows(book, t, a, s): diagonal risk, so each solve is elementwise."""
    dec = f"(1-exp(-ln(2.0::double)/{hl}))"
    return f"""select book, cast(0 as bigint) as t, list_transform(a, lambda v: 0.0::double) as x, 0.01::double/{ppy} as va from {rows} where t=1
 union all select book, t, list_transform(x3, lambda v: greatest(-0.3,least(0.3,v*scale))), va from (select *, case when rv>1e-8 then greatest(0.1,least(5,least((0.1/rv)**2, cap))) else 1 end as scale from (
  select *, sqrt(greatest(va,0)*{ppy}) as rv, case when list_max(list_transform(x3, lambda v: abs(v)))>0 then 0.3/list_max(list_transform(x3, lambda v: abs(v))) else 1e300 end as cap from (
   select b.book, r.t, list_transform(r.a, lambda v, i: greatest(-0.3,least(0.3,(v+0.5*b.x[i])/(r.s[i]+0.5)))) as x3, case when q.pr is null then b.va else (1-{dec})*b.va+{dec}*list_dot_product(b.x, q.pr)**2 end as va
   from {{own}} b join {rows} r on r.book=b.book and r.t=b.t+1 left join {prl} q on q.book=b.book and q.t=b.t)))"""


def walk_ctes(name, raw):
    """Every table of a walk over raw(book, date, a, s, assets) that holds only complete dates."""
    cte(f"{name}_t", f"select *, row_number() over (partition by book order by date) as t, lead(date) over (partition by book order by date) as next from {raw} where book in (select book from {raw} group by book having count(*)>=20)")
    cte(f"{name}_pr", f"select b.book, b.date, b.t, r.asset, case when b.next-b.date>60 then 0 else coalesce(sum(r.ret),0) end as pr from {name}_t b join ret_w r on list_contains(b.assets, r.asset) and r.date>b.date and r.date<=b.next group by b.book, b.date, b.t, r.asset, b.next")
    cte(f"{name}_prl", f"select book, t, list(pr order by asset) as pr from {name}_pr group by book, t")
    cte(f"{name}_x", walk_sql(f"{name}_t", f"{name}_prl").format(own=f"{name}_x"))
    cte(f"{name}_w", f"select x.book, r.date, x.t, unnest(r.assets) as asset, unnest(x.x) as w from {name}_x x join {name}_t r on r.book=x.book and r.t=x.t")


# Regimes act on the alphas before the walk; a book's inactive dates are no rebalance dates.
cte("rg_raw", """select r.book, r.date, list_transform(r.a, lambda v: v*coalesce(c.alpha_multiplier,1)) as a, r.s, r.assets from bk_rows r left join act_x c on c.date=r.date+1 and c.book=r.book where coalesce(c.active, true)""")
walk_ctes("rg", "rg_raw")


@query("allocator_with_regime", "O8 J15", """select date, round(sum(pnl),6) as pnl from (select w.book, w.date, sum(w.w*p.pr) as pnl from rg_w w join rg_pr p on p.book=w.book and p.t=w.t and p.asset=w.asset group by 1, 2) group by date""")
def _(spark, d):
    acts = regime_acts(spark, d).withColumn("date", F.date_sub("date", 1))
    p = base(spark, d)
    a = asof.apply_regime(alphas(p), acts)
    x = materialize(op.book_inputs(a, diagonal(p), p), "book-inputs")
    w = op.run_books(x, op.grid(x, POINTS[:1]))
    return rounded(op.allocate(op.book_pnl(w, op.period_returns(p, x.select("book", "date")))))


@query("asset_contributions", "O6 O11", "select book, point, date, asset, round(contribution,6) as contribution from bk_c")
def _(spark, d):
    _, _, w, pr = walked(spark, d)
    return rounded(op.contributions(w, pr).select("book", "point", "date", "asset", "contribution"))


@query("attribution_by_asset", "O11", "select book, point, asset, round(sum(contribution),6) as total from bk_c group by 1,2,3")
def _(spark, d):
    _, _, w, pr = walked(spark, d)
    return rounded(op.attribution(op.contributions(w, pr), ["book", "point", "asset"], False))


@query("attribution_cumulative", "O11", "select point, date, round(sum(c) over (partition by point order by date),5) as cumulative, round(c,6) as contribution from (select point, date, sum(contribution) as c from bk_c group by 1,2)")
def _(spark, d):
    _, _, w, pr = walked(spark, d)
    return rounded(op.attribution(op.contributions(w, pr), ["point"]), 6, cumulative=5)


@query("sector_net_reconciliation", "O12", "select distinct book, point, 0.0::double as max_gap from bk_w")
def _(spark, d):
    _, pts, w, pr = walked(spark, d)
    c = op.contributions(w, pr).withColumn("sector", F.when(F.substring("asset", -1, 1) < "5", "low").otherwise("high"))
    return rounded(op.reconcile(op.net_by_sector(c, costs(spark, d)), op.book_pnl(w, pr, pts, costs(spark, d))), 8)


@query("sector_net_breakdown", "O12", """select book, point, case when right(c.asset,1)<'5' then 'low' else 'high' end as sector, date, round(sum(contribution-coalesce(tr*cost_bps/10000,0)),6) as net from bk_c c left join cost_w k on k.asset=c.asset group by 1,2,3,4""")
def _(spark, d):
    _, _, w, pr = walked(spark, d)
    c = op.contributions(w, pr).withColumn("sector", F.when(F.substring("asset", -1, 1) < "5", "low").otherwise("high"))
    return rounded(op.net_by_sector(c, costs(spark, d)))


@query("pnl_statistics", "O13", """with p as (select book, point, date, (gross-penalty-cost)/10 as r from bk_pnl), w as (select *, product(1+r) over (partition by book, point order by date) as wl from p),
 dd as (select *, wl/nullif(max(wl) over (partition by book, point order by date),0)-1 as dd from w), q as (select book, point, quantile_cont(r,0.05) as v from p group by 1,2)
select d.book, d.point, count(*) as n, round(avg(r)/stddev_samp(r)*sqrt(52),5) as sharpe, round(min(dd),5) as max_drawdown, round(v,6) as "var", round(avg(r) filter (where r<=v),6) as es from dd d join q on q.book=d.book and q.point=d.point group by d.book, d.point, v""")
def _(spark, d):
    from termflow.operators import risk
    _, pts, w, pr = walked(spark, d)
    p = op.book_pnl(w, pr, pts, costs(spark, d)).select("book", "point", "date", (F.col("pnl") / 10).alias("r"))
    p = materialize(p, "book-pnl")
    k = ["book", "point"]
    s = bt.drawdown(p, "r", tuple(k)).groupBy(*k).agg(F.count("r").alias("n"), bt.sharpe("r", 52).alias("sharpe"), F.min("drawdown").alias("max_drawdown"))
    return rounded(s.join(risk.historical_tail(p, k, "r"), k), 5, var=6, es=6)


def stats_sql(cut):
    return f"""select book, point, count(*) as n, avg(r)/stddev_samp(r)*sqrt(52) as sharpe, min(dd) as max_drawdown from (select *, wl/nullif(max(wl) over (partition by book, point order by date),0)-1 as dd from (
  select *, product(1+r) over (partition by book, point order by date) as wl from (select book, point, date, (gross-penalty-cost)/10 as r from bk_pnl where date<=date '{cut}'))) group by book, point"""


CUTS = {"2001-03-30": "2001-03-30", "2001-04-06": "2001-04-06"}


@query("pnl_report_difference", "O13", f"""with a as ({stats_sql('2001-03-30')}), b as ({stats_sql('2001-04-06')}), r as (
 select '2001-03-30' as run, book, point, unnest([{{'metric':'n','value':n::double}},{{'metric':'sharpe','value':sharpe}},{{'metric':'max_drawdown','value':max_drawdown}}], recursive:=true) from a union all
 select '2001-04-06', book, point, unnest([{{'metric':'n','value':n::double}},{{'metric':'sharpe','value':sharpe}},{{'metric':'max_drawdown','value':max_drawdown}}], recursive:=true) from b)
select x.run, case when x.run='2001-04-06' then '2001-03-30' end as prior_run, x.book, x.point, x.metric, round(x.value,5) as value, round(y.value,5) as prior_value, round(x.value-y.value,5) as delta
 from r x left join r y on y.run='2001-03-30' and x.run='2001-04-06' and y.book=x.book and y.point=x.point and y.metric=x.metric""")
def _(spark, d):
    """Two weekly reports and what changed between them."""
    _, pts, w, pr = walked(spark, d)
    p = materialize(op.book_pnl(w, pr, pts, costs(spark, d)).select("book", "point", "date", (F.col("pnl") / 10).alias("r")), "book-pnl")
    k, rows = ["book", "point"], None
    for run, cut in CUTS.items():
        s = bt.drawdown(p.where(F.col("date") <= cut), "r", tuple(k)).groupBy(*k).agg(F.count("r").alias("n"), bt.sharpe("r", 52).alias("sharpe"), F.min("drawdown").alias("max_drawdown"))
        x = op.report_rows(s, k, run)
        rows = x if rows is None else rows.unionByName(x)
    return rounded(op.against_prior(materialize(rows, "reports"), k), 5)


@query("book_grid_sharpe_by_split", "T10 B12", f"""with t as (select *, {SPLIT} as split from bk_mark), k as (select *, row_number() over (partition by book, point, split order by date) as k from t)
select book, point, {SPLITS_SQL} from k where split='train' or k>1 or (split='validation' and exists (select 1 from pnl_w where date=date '1999-12-31')) or (split='test' and exists (select 1 from pnl_w where date=date '2000-12-31')) group by book, point""")
def _(spark, d):
    panel, _, w, _ = walked(spark, d)
    m = op.daily_mark(w, panel, cost_bps=costs(spark, d))
    return rounded(bt.sharpe_by_split(bt.split_tag(m, "1999-12-31", "2000-12-31", ("book", "point")), ["book", "point"], ppy=52), 5)


@query("book_garch_target", "O4 V7")
def _(spark, d):
    x = inputs(base(spark, d))
    return op.run_books(x, op.grid(x, [dict(BASE, point="garch", garch=True)]))


@query("book_covariance_swap", "O10")
def _(spark, d):
    """The same alphas under three covariance estimators, the estimator being part of the book key."""
    r = base(spark, d)
    c = materialize(cv.estimates(r, window=52, freq="weekly", min_frac=0.3), "swap-cov", ("estimator",))
    out = None
    for name in ("sample", "shrunk", "comovement"):
        x = op.book_inputs(alphas(r), c.where(F.col("estimator") == name).drop("estimator"), r)
        x = x.withColumn("book", F.concat_ws("|", F.lit(name), "book"))
        out = x if out is None else out.unionByName(x)
    x = materialize(out, "swap-inputs")
    w = op.run_books(x, op.grid(x, POINTS[:1]))
    return bt.sharpe_by_split(bt.split_tag(op.daily_mark(w, r), "1999-12-31", "2000-12-31", ("book", "point")), ["book"], ppy=52)


# The swap with diagonal estimators, by month: sample and shrunk variances give different books from the same alphas.
cte("sv_var", "select 'sample' as e, rd, i, sxx/(n-1) as v from cpair where i=j union all select 'shrunk', rd, i, cov from lw_x where i=j")
cte("sv_raw", """select e || '|' || book as book, date, a, s, assets from (select v.e, r.book, r.date, r.a, r.assets, list(v.v order by v.i) as s from bk_rows r join sv_var v on v.rd=r.date and list_contains(r.assets, v.i) group by v.e, r.book, r.date, r.a, r.assets) where len(s)=len(a)""")
walk_ctes("sv", "sv_raw")
cte("sv_mark", """select g.book, g.date, coalesce(sum(g.h*r.ret),0) as pnl from (select book, asset, date, lag(held) over (partition by book, asset order by date) as h from (
  select a.book, a.asset, c.date, last_value(w.w ignore nulls) over (partition by a.book, a.asset order by c.date) as held from (select distinct book, asset from sv_w) a cross join cal_n c left join sv_w w on w.book=a.book and w.asset=a.asset and w.date=c.date)) g
  left join ret_w r on r.asset=g.asset and r.date=g.date group by g.book, g.date""")


@query("book_variance_swap", "O10", f"""select book, {SPLITS_SQL} from (select *, row_number() over (partition by book, split order by date) as k from (select *, {SPLIT} as split from sv_mark))
 where split='train' or k>1 or (split='validation' and exists (select 1 from pnl_w where date=date '1999-12-31')) or (split='test' and exists (select 1 from pnl_w where date=date '2000-12-31')) group by book""")
def _(spark, d):
    r = base(spark, d)
    m = materialize(cv.moment_covariances(r, window=52, min_frac=0.3), "swap-moments")
    out = None
    for name in ("sample", "shrunk"):
        c = m.select("rebalance_date", "i", "j", F.when(F.col("i") == F.col("j"), F.col(name)).otherwise(0.0).alias("cov"))
        x = op.book_inputs(alphas(r), c, r).withColumn("book", F.concat_ws("|", F.lit(name), "book"))
        out = x if out is None else out.unionByName(x)
    x = materialize(out, "swap-inputs")
    w = op.run_books(x, op.grid(x, POINTS[:1]))
    t = bt.split_tag(op.daily_mark(w, r), "1999-12-31", "2000-12-31", ("book", "point"))
    return rounded(bt.sharpe_by_split(t, ["book"], ppy=52), 5)


@query("adopted_book_inputs", "O9 K5", """select book, date, len(a) as n_assets, round(list_sum(a),5) as alpha_sum from bk_rows where book in (select book from bk_rows group by book having count(*)>=20)""")
def _(spark, d):
    x = inputs(base(spark, d))
    return rounded(x.select("book", "date", F.size("a").cast("long").alias("n_assets"), F.aggregate("a", F.lit(0.0), lambda s, v: s + v).alias("alpha_sum")), 5)


@query("spec_registry_union", "K5", "select spec, count(signal) as n, round(sum(signal),4) as total from (select spec, signal from spec_raw union all select 'rank', case when count(mom) over (partition by date, sector)>=2 then (case when mom is not null then rank() over (partition by date, sector order by mom nulls last)+(count(mom) over (partition by date, sector, mom)-1)/2.0 end)-(count(mom) over (partition by date, sector)+1)/2.0 end from mom_w) group by spec")
def _(spark, d):
    from termflow.operators import xs
    from termflow.plans.q_backtest import spec_positions
    a = spec_positions(spark, d).select("spec", "signal")
    b = mk.mom_w(spark, d).select(F.lit("rank").alias("spec"), xs.sector_rank("mom").alias("signal"))
    return rounded(a.unionByName(b).groupBy("spec").agg(F.count("signal").alias("n"), F.sum("signal").alias("total")), 4)
