"""Trend flavours, adopted books and the pair book: specs, universes and winners as rows."""
from pyspark.sql import functions as F

from termflow.functions.cols import rounded
from termflow.operators import backtest as bt, book, registry as op, tuning, universe
from termflow.operators.signals import relative_value as rv
from termflow.plans import q_book as qb
from termflow.plans.q_backtest import SPLIT, TRAIN, VAL, sh
from termflow.plans.q_cross import WINDOWS
from termflow.plans.q_rv import registry, spreads
from termflow.plans.q_xs import arank
from termflow.plans.registry import cte, query
from termflow.session import materialize
from termflow.sources import driver_views as dv, market as mk

# Two signals, then everything that blends them.
cte("fl_in", """select v.asset, v.date, v.ret, v.vol, m.signal as mom, 0.4*sign(case when count(v.close) over a>=2 then avg(v.close) over a end-case when count(v.close) over b>=8 then avg(v.close) over b end)/nullif(v.vol,0) as crs,
  lead(v.ret) over (partition by v.asset order by v.date) as fwd, m.mom as raw from vol_w v join sig_w m on m.asset=v.asset and m.date=v.date
 window a as (partition by v.asset order by v.date rows between 3 preceding and current row), b as (partition by v.asset order by v.date rows between 11 preceding and current row)""")
cte("fl_two", "select asset, date, ret, fwd, 'mom' as spec, mom as signal from fl_in union all select asset, date, ret, fwd, 'cross', crs from fl_in")
cte("fl_ic", f"""select spec, date, case when count(*)>=2 and stddev_samp(a)*stddev_samp(b)>0 then covar_samp(a,b)/(stddev_samp(a)*stddev_samp(b)) end as ic from (
  select spec, date, {arank('signal', 'spec, date')} as a, {arank('fwd', 'spec, date')} as b from fl_two where signal is not null and fwd is not null) group by spec, date""")
cte("fl_icw", """select spec, date, case when coalesce(sum(w) over (partition by date),0)<1e-8 then 0.5 else w/sum(w) over (partition by date) end as weight from (
  select c.spec, c.date, case when count(ic) over p>=20 then greatest(avg(ic) over p,0) end as w from (select distinct spec, date from fl_two) c left join fl_ic i on c.spec=i.spec and c.date=i.date
  window p as (partition by c.spec order by c.date rows between 52 preceding and 1 preceding))""")
cte("fl_held", """select 'cross' as spec, asset, date, ret, lag(crs) over (partition by asset order by date) as p from fl_in union all
 select 'mom', asset, date, ret, lag(held) over (partition by asset order by date) from (select f.asset, f.date, f.ret, last_value(m.v ignore nulls) over (partition by f.asset order by f.date) as held
  from fl_in f left join (select asset, last_day(date) as label, arg_max(mom, date) filter (where mom is not null) as v from fl_in group by asset, 2) m on m.asset=f.asset and m.label=f.date)""")
cte("fl_pnl", "select spec, date, coalesce(sum(pos*ret),0) as pnl from (select *, coalesce(p/nullif(sum(abs(p)) over (partition by spec, date),0),0) as pos from fl_held) group by spec, date")
cte("fl_rpw", """select spec, date, case when coalesce(sum(w) over (partition by date),0)<1e-8 then 0.5 else w/sum(w) over (partition by date) end as weight from (
  select spec, date, case when count(pnl) over p>=20 and stddev_samp(pnl) over p>0 then 1/stddev_samp(pnl) over p end as w from fl_pnl
  window p as (partition by spec order by date rows between 52 preceding and 1 preceding))""")
cte("fl_w", """select date, max(case when spec='mom' then ic end) as icm, max(case when spec='cross' then ic end) as icc, max(case when spec='mom' then rp end) as rpm, max(case when spec='cross' then rp end) as rpc
 from (select i.spec, i.date, i.weight as ic, r.weight as rp from fl_icw i full join fl_rpw r on r.spec=i.spec and r.date=i.date) group by date""")
cte("fl_dead", """select asset, date, case when raw is null then null when abs(raw)>=thr then 0.4*sign(raw)/nullif(vol,0) else 0 end as dead from (
 select *, case when count(raw) over w>=20 then quantile_cont(abs(raw),0.5) over w end as thr from fl_in window w as (partition by asset order by date rows between 52 preceding and 1 preceding))""")
cte("fl_x", """select f.asset, f.date, f.ret, u.flavour, case u.flavour when 'tsmom_alone' then mom when 'equal_weight' then (mom+crs)/2 when 'fixed_70_30' then 0.7*mom+0.3*crs when 'ic_weighted' then icm*mom+icc*crs
   when 'risk_parity' then rpm*mom+rpc*crs when 'confirmation' then mom*case when sign(mom)=sign(crs) then 1.0 else 0.0 end when 'tsmom_deadband' then d.dead else mom*s.weight end as signal
 from fl_in f join fl_dead d on d.asset=f.asset and d.date=f.date left join fl_w w on w.date=f.date join season_w s on s.asset=f.asset and s.date=f.date
 cross join (values ('tsmom_alone'),('equal_weight'),('fixed_70_30'),('ic_weighted'),('risk_parity'),('confirmation'),('tsmom_deadband'),('tsmom_seasonal')) u(flavour)""")


def flavours(spark, d):
    return op.trend_flavours(mk.vol_w(spark, d), WINDOWS, 12, (4, 12), 0.4, (0.5, 52, 20), 52)


@query("trend_flavours", "K5", "select flavour, asset, date, round(signal,6) as signal from fl_x")
def _(spark, d):
    return rounded(flavours(spark, d).drop("ret"))


# Three adopted books: two flavours on a universe without its redundant members, one on every asset; an asset needs returns on 90 % of the rows.
BOOKS = (("trend", "tsmom_alone", "trend"), ("blend", "ic_weighted", "rank"), ("season", "tsmom_seasonal", ""))
cte("ab_books", "select * from (values ('trend','tsmom_alone'),('blend','ic_weighted'),('season','tsmom_seasonal')) b(book, flavour)")
cte("ab_members", """select b.book, a.asset from ab_books b, (select distinct asset, cast(replace(asset,'NATION_','') as integer) as k from bars_w) a
 where b.book='season' or (b.book='trend' and a.k%5<>0 and a.k%7<>0) or (b.book='blend' and a.k%5<>0)""")
cte("ab_rows", "select b.book, x.asset, x.date, x.ret, x.signal from fl_x x join ab_books b using (flavour) join ab_members m on m.book=b.book and m.asset=x.asset")
cte("ab_alpha", """select r.book, r.asset, r.date, r.signal/case when s.sd>1e-12 then s.sd else 1 end as alpha from ab_rows r
 join (select book, asset from ab_rows group by book, asset having count(signal)>0 and count(ret)>=0.9*count(*)) k on k.book=r.book and k.asset=r.asset
 left join (select x.book, stddev_samp(signal) as sd from ab_rows x join (select book, asset from ab_rows group by book, asset having count(signal)>0 and count(ret)>=0.9*count(*)) k on k.book=x.book and k.asset=x.asset
  where date<=date '1999-12-31' group by x.book) s on s.book=r.book""")
cte("ab_n", "select book, count(distinct asset) as n from ab_alpha group by book")
cte("ab_list", """select a.book, a.date, list(a.alpha order by a.asset) as a, list(v.vol*v.vol/52 order by a.asset) as s, list(a.asset order by a.asset) as assets from ab_alpha a join vol_w v on v.asset=a.asset and v.date=a.date
 where a.alpha is not null and v.vol is not null group by a.book, a.date""")
cte("ab_t", "select *, row_number() over (partition by book order by date) as t, lead(date) over (partition by book order by date) as next from ab_list join ab_n using (book) where len(a)=n")
cte("ab_ok", "select * from ab_t where book in (select book from ab_t group by book having count(*)>=20)")
cte("ab_pr", """select b.book, b.t, r.asset, case when b.next-b.date>60 then 0 else coalesce(sum(r.ret),0) end as pr from ab_ok b join ret_w r on list_contains(b.assets, r.asset) and r.date>b.date and r.date<=b.next group by b.book, b.date, b.t, r.asset, b.next""")
cte("ab_prl", "select book, t, list(pr order by asset) as pr from ab_pr group by book, t")
DEC = "(1-exp(-ln(2.0::double)/26))"


cte("ab_e", f"""select book, cast(0 as bigint) as t, list_transform(a, lambda v: 0.0::double) as x, 0.01::double/52 as va from ab_ok where t=1
 union all select book, t, list_transform(x3, lambda v: greatest(-0.3,least(0.3,v*scale))), va from (select *, case when rv>1e-8 then greatest(0.1,least(5,least((0.1/rv)**2, cap))) else 1 end as scale from (
  select *, sqrt(greatest(va,0)*52) as rv, case when list_max(list_transform(x3, lambda v: abs(v)))>0 then 0.3/list_max(list_transform(x3, lambda v: abs(v))) else 1e300 end as cap from (
   select b.book, r.t, list_transform(r.a, lambda v, i: greatest(-0.3,least(0.3,(v+0.5*b.x[i])/(r.s[i]+0.5)))) as x3, case when q.pr is null then b.va else (1-{DEC})*b.va+{DEC}*list_dot_product(b.x, q.pr)**2 end as va
   from ab_e b join ab_ok r on r.book=b.book and r.t=b.t+1 left join ab_prl q on q.book=b.book and q.t=b.t)))""")


def adopted(spark, d):
    """(alphas, panel with volatility)"""
    v = materialize(mk.vol_w(spark, d).select("asset", "sector", "date", "close", "ret", "vol"), "adopted-panel")
    x = op.trend_flavours(v, WINDOWS, 12, (4, 12), 0.4, (0.5, 52, 20), 52).withColumnRenamed("flavour", "spec")
    books = spark.createDataFrame([b[:2] for b in BOOKS], "book string, spec string")
    every = v.select("asset").distinct()
    k = F.replace("asset", F.lit("NATION_"), F.lit("")).cast("int")
    redundant = every.where(k % 5 == 0).withColumn("scope", F.lit("all")).unionByName(every.where(k % 7 == 0).withColumn("scope", F.lit("trend")))
    members = None
    for name, _, family in BOOKS:
        m = (universe.compress(every, redundant, family) if family else every).select(F.lit(name).alias("book"), "asset")
        members = m if members is None else members.unionByName(m)
    return op.registered_books(x, books, members, TRAIN), v


@query("adopted_book_alphas", "O9 K5 F12", "select book, asset, date, round(alpha,5) as alpha from ab_alpha")
def _(spark, d):
    return rounded(adopted(spark, d)[0].select("book", "asset", "date", "alpha"), 5)


def adopted_inputs(spark, d):
    a, v = adopted(spark, d)
    a = materialize(a, "adopted-alphas")
    var = v.where("vol is not null").select(F.col("asset").alias("i"), F.col("date").alias("rebalance_date"), (F.col("vol") * F.col("vol") / 52).alias("v"))
    names = v.select(F.col("asset").alias("j")).distinct()
    pairs = var.select("rebalance_date", "i", "v", F.explode(names.agg(F.array_sort(F.collect_set("j")).alias("c")).scalar()).alias("j"))
    cov = pairs.select("rebalance_date", "i", "j", F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0).alias("cov"))
    return materialize(book.book_inputs(a.select("book", "asset", "date", "alpha"), cov, v), "adopted-inputs")


@query("adopted_books", "O9", "select x.book, r.date, unnest(r.assets) as asset, round(unnest(x.x),6) as w from ab_e x join ab_ok r on r.book=x.book and r.t=x.t")
def _(spark, d):
    x = adopted_inputs(spark, d)
    return rounded(book.run_books(x, book.grid(x, qb.POINTS[:1])).select("book", "date", "asset", "w"))


# The pair book: each pair's entry rule by validation Sharpe net of both legs' costs, weekly.
cte("pb_sig", """select n.pair, n.date, n.chg as ret, s.spec, case s.spec when 'continuous' then -z/nullif(vol,0) else sign(b.outv)/nullif(vol,0) end as signal from band_x b join pair_n n on b.pair=n.pair and b.t=n.t
 cross join (values ('continuous'),('threshold')) s(spec)""")
cte("pb_cost", "select p.pair, coalesce(a.cost_bps,0)+coalesce(b.cost_bps,0) as cost_bps from pairs p left join cost_w a on a.asset=p.leg_y left join cost_w b on b.asset=p.leg_x")
cte("pb_pos", """select *, abs(pos-lag(pos) over (partition by pair, spec order by date)) as t from (select *, coalesce(p/nullif(abs(p),0),0) as pos from (
 select s.pair, s.spec, s.date, s.ret, lag(held) over (partition by s.pair, s.spec order by s.date) as p from (select g.*, last_value(g.signal ignore nulls) over (partition by g.pair, g.spec order by g.date) as held from pb_sig g) s))""")
cte("pb_sh", f"""select pair, spec, {sh('validation')} as validation from (select *, row_number() over (partition by pair, spec, split order by date) as k from (
 select p.pair, p.spec, p.date, coalesce(pos*ret,0)-coalesce(t*cost_bps/10000,0) as pnl, {SPLIT} as split from pb_pos p join pb_cost c using (pair)))
 where split='train' or k>1 or (split='validation' and exists (select 1 from pnl_w where date=date '1999-12-31')) or (split='test' and exists (select 1 from pnl_w where date=date '2000-12-31')) group by pair, spec""")
cte("pb_win", """select p.pair, coalesce(w.spec,'continuous') as winner from pairs p left join (select * from (select *, row_number() over (partition by pair order by validation desc, spec desc) as k from pb_sh where validation is not null) where k=1) w using (pair)""")


@query("pair_book_inputs", "O9 B18 B16", """select s.pair, s.date, w.winner, round(s.signal,6) as alpha, round(s.ret,6) as ret, c.cost_bps, k.active from pb_sig s join pb_win w on w.pair=s.pair and w.winner=s.spec join pb_cost c on c.pair=s.pair
 join (select pair, count(signal)>0 and count(ret)>=0.9*count(*) as active from pb_sig s join pb_win w using (pair) where w.winner=s.spec group by pair) k on k.pair=s.pair""")
def _(spark, d):
    s = op_signals(spark, d)
    legs = registry(spark, d).select("pair", F.explode(F.array("leg_y", "leg_x")).alias("asset"))
    cost = materialize(op.leg_costs(legs, bt.tiered_cost_bps(dv.bars_w(spark, d), "1999-01-01")), "pair-costs")
    table = rounded(op.spec_sharpes(s, cost, TRAIN, VAL, "weekly", ppy=52), 5)
    win = materialize(tuning.winner_per_key(table, "pair", "spec", "validation", "continuous", registry(spark, d).select("pair")), "pair-winners")
    x = op.chosen_specs(s, win).join(win.select("pair", "winner"), "pair").join(cost, "pair")
    g = x.groupBy("pair").agg(((F.count("signal") > 0) & (F.count("ret") >= 0.9 * F.count(F.lit(1)))).alias("active"))
    return rounded(x.join(g, "pair").select("pair", "date", "winner", F.col("signal").alias("alpha"), "ret", "cost_bps", "active"))


def op_signals(spark, d):
    """(pair, spec, date, ret, signal) of both entry rules, written once."""
    x = rv.pair_signals(spreads(spark, d), 26, 26, entry=1.5, ppy=52).withColumnRenamed("change", "ret")
    return materialize(x.unpivot(["pair", "date", "ret"], ["continuous", "threshold"], "spec", "signal"), "pair-specs")
