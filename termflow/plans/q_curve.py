"""Term structure and carry."""
from pyspark.sql import functions as F

from termflow.functions.calendar import week_end
from termflow.functions.cols import rounded
from termflow.operators import curve as op
from termflow.plans.registry import cte, query
from termflow.session import materialize, scratch_path
from termflow.sources import driver_views as dv, market as mk, readers

cte("contracts", """select asset, sector, date, root || code || lpad(cast(ey%100 as varchar),2,'0') as contract_symbol, root, ey as expiry_year, code as expiry_code,
  ey*12+em as m, open, high, low, close, volume from (
 select asset, sector, date, 'N' || split_part(asset,'_',2) as root, cast(year(exp) as integer) as ey, month(exp) as em, substr('FGHJKMNQUVXZ', cast(month(exp) as integer), 1) as code,
  cast(arg_min(px, cast(l_orderkey as hugeint)*10000000000000000::hugeint+px) as double)/100 as open, max(px)/100.0::double as high, min(px)/100.0::double as low,
  cast(sum(px) as double)/100.0::double/count(*) as close, sum(l_quantity) as volume
 from (select *, cast(date_trunc('month', date) + to_months(l_linenumber) as date) as exp from li) group by asset, sector, date, exp)""")
cte("quotes", """select * from (select asset, date, contract_symbol || '-' || f.contract_symbol as spread_symbol, root as near_root, contract_symbol as near_contract_symbol,
  expiry_year as near_expiry_year, expiry_code as near_expiry_code, case when cast(volume as bigint)%7=3 then 'ZZ' else f.root end as far_root,
  f.contract_symbol as far_contract_symbol, f.expiry_year as far_expiry_year, f.expiry_code as far_expiry_code,
  close-f.close+(volume-f.volume)/4 as close, volume+f.volume as volume, m as near_m, f.m as far_m
 from (select *, unnest([lead(s,1) over w, lead(s,2) over w]) as f from (select *, {'root':root,'contract_symbol':contract_symbol,'expiry_year':expiry_year,'expiry_code':expiry_code,'close':close,'volume':volume,'m':m} as s from contracts)
   window w as (partition by asset, date order by m)) where f is not null)""")
cte("front_n", "select asset, date, arg_min(contract_symbol, m) as front_contract_symbol from contracts group by asset, date")
cte("proxy_d", """select asset, date, (close-fc)/nullif(close,0)*365/((fm-m)*30.44) as carry from (
  select *, lead(close) over w as fc, lead(m) over w as fm, row_number() over w as k from contracts window w as (partition by asset, date order by m)) where k=1 and fc is not null""")
cte("fspread", """select asset, date, near_contract_symbol, far_contract_symbol, close, near_m, far_m from (select q.*, row_number() over (partition by q.asset, q.date order by far_m) as k
  from quotes q join front_n f on q.asset=f.asset and q.date=f.date and q.near_contract_symbol=f.front_contract_symbol where near_root=far_root) where k=1""")
cte("real_d", """select s.asset, s.date, s.close/nullif(c.close,0)*365/((far_m-near_m)*30.44) as carry from fspread s
  left join contracts c on s.asset=c.asset and s.date=c.date and s.near_contract_symbol=c.contract_symbol""")


def curve_inputs(spark, d):
    """(contracts, same-product quotes, nearest front): contracts are written once, the rest derives from them."""
    c = materialize(dv.contracts(spark, d), "contracts")
    return c, dv.spreads(c).where("near_root = far_root"), dv.nearest_front(c)


@query("contract_bars", "S7", "select asset, date, contract_symbol, root, expiry_year, expiry_code, open, high, low, close, volume from contracts")
def _(spark, d):
    return dv.contracts(spark, d).drop("sector")


@query("same_root_spreads", "F8", """select asset, date, spread_symbol, round(close,6) as close, volume from quotes where near_root=far_root""")
def _(spark, d):
    return rounded(dv.spreads(dv.contracts(spark, d)).where("near_root = far_root").select("asset", "date", "spread_symbol", "close", "volume"))


@query("contract_chain", "C1", "select asset, contract_symbol, m, row_number() over (partition by asset order by m) as chain_idx from (select distinct asset, contract_symbol, m from contracts)")
def _(spark, d):
    return op.contract_chain(dv.contracts(spark, d))


cte("chain_x", "select asset, contract_symbol, row_number() over (partition by asset order by m) as i from (select distinct asset, contract_symbol, m from contracts)")
cte("days_x", """select asset, date, row_number() over (partition by asset order by date) as t, legs from (select c.asset, c.date,
  list({'i':x.i,'v':c.volume} order by x.i) as legs from contracts c join chain_x x on c.asset=x.asset and c.contract_symbol=x.contract_symbol group by c.asset, c.date)""")
cte("seen_x", """select c.asset, x.i, max(d.t) as lt from contracts c join chain_x x on c.asset=x.asset and c.contract_symbol=x.contract_symbol
  join days_x d on d.asset=c.asset and d.date=c.date group by c.asset, x.i""")
cte("step_x", """select asset, cast(0 as bigint) as t, cast(list_sort(list_transform(legs, lambda x: {'v':-x.v,'i':x.i}))[1].i as bigint) as front, cast(null as bigint) as pend, 0 as cnt from days_x where t=1
 union all select asset, t, case when roll then nxt else front end, case when roll or not sig then null else nxt end, case when roll or not sig then 0 else newcnt end from (
  select *, sig and newcnt>=2 or (nxt is not null and lt-t<=5) as roll from (
   select *, case when pend=nxt then cnt+1 else 1 end as newcnt, coalesce(nv>0 and fv>0 and nv>fv, false) as sig from (
    select s.asset, d.t, s.front, s.pend, s.cnt, e.lt, list_filter(d.legs, lambda x: x.i>s.front)[1].i as nxt, list_filter(d.legs, lambda x: x.i>s.front)[1].v as nv,
      list_filter(d.legs, lambda x: x.i=s.front)[1].v as fv from step_x s join days_x d on d.asset=s.asset and d.t=s.t+1 left join seen_x e on e.asset=s.asset and e.i=s.front)))""")
cte("front_x", """select d.asset, d.date, c.contract_symbol as front_contract_symbol from step_x s join days_x d on s.asset=d.asset and s.t=d.t
  join chain_x c on c.asset=s.asset and c.i=s.front""")
cte("roll_x", """select f.*, lag(front_contract_symbol) over (partition by asset order by date) as old from front_x f""")
cte("curve_x", """select r.asset, r.date, r.front_contract_symbol, n.open, n.high, n.low, n.close, n.volume, coalesce(r.front_contract_symbol<>r.old,false) as is_roll_date,
  case when r.front_contract_symbol<>r.old and n.close>0 and o.close>0 then n.close/o.close else 1 end as ratio
  from roll_x r left join contracts n on n.asset=r.asset and n.date=r.date and n.contract_symbol=r.front_contract_symbol
  left join contracts o on o.asset=r.asset and o.date=r.date and o.contract_symbol=r.old""")


def landed(df, schema, name):
    """Write the columns of a declared layout as a landing job does; returns the folder."""
    path = scratch_path(df.sparkSession, name)
    cols = [c.strip().split(" ") for c in schema.split(",")]
    df.select(*[F.col(c).cast(t).alias(c) for c, t in cols]).write.parquet(path)
    return path


@query("outrights_load", "S7", "select asset, date, contract_symbol, root, 'XDRV' as exchange, expiry_year, expiry_code, open, high, low, close, volume::bigint as volume from contracts")
def _(spark, d):
    path = landed(dv.contracts(spark, d).withColumn("exchange", F.lit("XDRV")), readers.TERM_STRUCTURE, "outrights")
    return readers.outrights(spark, path)


def landed_curve(spark, d):
    return landed(op.continuous_curve(curve_inputs(spark, d)[0]), readers.CONTINUOUS, "continuous")


@query("continuous_load_raw", "S4", """select asset, date, round(open,4) as open, round(high,4) as high, round(low,4) as low, round(close,4) as close, volume::bigint as volume, is_roll_date from curve_x""")
def _(spark, d):
    return rounded(readers.continuous(spark, landed_curve(spark, d)), 4)


@query("continuous_load_adjusted", "S5", """select asset, date, volume::bigint as volume, """ + ", ".join(f"round(ln({c}) + coalesce(sum(ln(ratio)) over (partition by asset order by date rows between 1 following and unbounded following),0),6) as log_{c}" for c in ("open", "high", "low", "close")) + " from curve_x")
def _(spark, d):
    a = readers.continuous(spark, landed_curve(spark, d), adjusted=True)
    return rounded(a.select("asset", "date", "volume", *[F.ln(c).alias(f"log_{c}") for c in ("open", "high", "low", "close")]))


@query("front_contract_assignment", "C2", "select asset, date, front_contract_symbol from front_x")
def _(spark, d):
    return op.assign_front(curve_inputs(spark, d)[0]).select("asset", "date", "front_contract_symbol")


@query("front_contract_bars", "J4", "select asset, date, front_contract_symbol, open, high, low, close, volume from curve_x")
def _(spark, d):
    c = curve_inputs(spark, d)[0]
    return op.front_bars(op.assign_front(c).drop("status"), c)


@query("curve_build_status", "C4", "select asset, 'OK' as status, count(distinct date) as days from bars_d group by asset")
def _(spark, d):
    return op.curve_status(op.assign_front(dv.contracts(spark, d)))


@query("outrights_by_volume", "C10", """select contract_symbol, asset, sum(volume) as volume from contracts group by 1, 2""")
def _(spark, d):
    return dv.contracts(spark, d).groupBy("contract_symbol", "asset").agg(F.sum("volume").alias("volume"))


@query("continuous_back_adjusted", "C3 C4 S4 S5", """select asset, date, front_contract_symbol, is_roll_date, round(close,4) as raw_close, volume,
  round(ln(close) + coalesce(sum(ln(ratio)) over (partition by asset order by date rows between 1 following and unbounded following),0),6) as log_adj_close,
  round(ln(high) + coalesce(sum(ln(ratio)) over (partition by asset order by date rows between 1 following and unbounded following),0),6) as log_adj_high from curve_x""")
def _(spark, d):
    return rounded(op.continuous_curve(curve_inputs(spark, d)[0]).select(
        "asset", "date", "front_contract_symbol", "is_roll_date", "raw_close", "volume",
        F.ln("adj_close").alias("log_adj_close"), F.ln("adj_high").alias("log_adj_high")), 6, raw_close=4)


@query("front_calendar_spread", "J5", "select asset, date, near_contract_symbol, far_contract_symbol, round(close,6) as close from fspread")
def _(spark, d):
    c, q, f = curve_inputs(spark, d)
    return rounded(op.front_spread(f, q).select(
        "asset", "date", "near_contract_symbol", "far_contract_symbol", "close"))


@query("quoted_carry", "J6", "select asset, date, round(carry,6) as carry from real_d")
def _(spark, d):
    c, q, f = curve_inputs(spark, d)
    return rounded(op.real_carry(f, q, c))


@query("proxy_carry", "J7", "select asset, date, round(carry,6) as carry from proxy_d")
def _(spark, d):
    c, _, f = curve_inputs(spark, d)
    return rounded(op.proxy_carry(f, c))


PROXY = "asset in ('NATION_0','NATION_5','NATION_11')"


def proxies(spark, d):
    return dv.table(spark, d, "nation").select(F.col("n_name").alias("asset")).where(PROXY)


@query("carry_panel", "J8", f"""select asset, date, round(carry,6) as carry, false as is_proxy from real_d where not ({PROXY})
 union all select asset, date, round(carry,6), true from proxy_d where {PROXY}""")
def _(spark, d):
    c, q, f = curve_inputs(spark, d)
    return rounded(op.carry_panel(f, q, c, proxies(spark, d)))


@query("rescaled_quote_carry", "J9", "select asset, date, round(carry*case when asset='NATION_3' then 0.01 else 1 end,6) as carry from real_d")
def _(spark, d):
    scale = dv.table(spark, d, "nation").where("n_name = 'NATION_3'").select(F.col("n_name").alias("asset"), F.lit(0.01).alias("scale"))
    c, q, f = curve_inputs(spark, d)
    return rounded(op.real_carry(f, q, c, scale))


OFF = "('NATION_3','NATION_17')"
cte("off_spread", """select * from (select q.asset, q.date, q.close, far_m-near_m as gap, q.near_contract_symbol as sym, row_number() over (partition by q.asset, q.date order by far_m) as k
  from quotes q join front_x f on q.asset=f.asset and q.date=f.date and q.near_contract_symbol=f.front_contract_symbol where near_root=far_root) where k=1""")


@query("off_panel_curve", "J9", f"""select c.asset, c.date, c.front_contract_symbol, c.is_roll_date, round(c.close,4) as raw_close,
  round(ln(c.close) + coalesce(sum(ln(ratio)) over (partition by c.asset order by c.date rows between 1 following and unbounded following),0),6) as log_adj_close,
  round(s.close*case when c.asset='NATION_3' then 0.01 else 1 end/nullif(c.close,0)*365/(s.gap*30.44),6) as carry from curve_x c left join off_spread s on s.asset=c.asset and s.date=c.date where c.asset in {OFF}""")
def _(spark, d):
    """Two assets that have contracts but no panel series: curve and carry from their own front contracts."""
    c, q, _ = curve_inputs(spark, d)
    panel = c.where(f"asset not in {OFF}").select("asset").distinct()
    curve = materialize(op.off_panel_curve(c, panel), "off-panel")
    scale = spark.createDataFrame([("NATION_3", 0.01)], "asset string, scale double")
    carry = op.off_panel_carry(curve, q, op.off_panel(c, panel), scale)
    x = curve.join(carry, ["asset", "date"], "left")
    return rounded(x.select("asset", "date", "front_contract_symbol", "is_roll_date", "raw_close", F.ln("adj_close").alias("log_adj_close"), "carry"), 6, raw_close=4)


@query("quote_vs_proxy_error", "J10", """select s.asset, s.date, round(abs(n.close-f.close-s.close)/abs(n.close),6) as error from fspread s
 join contracts n on n.asset=s.asset and n.date=s.date and n.contract_symbol=near_contract_symbol
 join contracts f on f.asset=s.asset and f.date=s.date and f.contract_symbol=far_contract_symbol""")
def _(spark, d):
    c, q, f = curve_inputs(spark, d)
    return rounded(op.quote_error(f, q, c))


@query("spread_carry_and_synthetic", "J22", """select q.asset, q.date, q.spread_symbol, round(q.close,6) as spread_close, round(q.close/n.close*365/((far_m-near_m)*30.44)*100,5) as carry_pct,
 round(n.close-f.close,6) as synthetic_spread from quotes q join contracts n on n.asset=q.asset and n.date=q.date and n.contract_symbol=near_contract_symbol
 join contracts f on f.asset=q.asset and f.date=q.date and f.contract_symbol=far_contract_symbol""")
def _(spark, d):
    c = curve_inputs(spark, d)[0]
    return rounded(op.spread_carry_table(dv.spreads(c), c), 6, carry_pct=5)


AS_OF = "2001-06-29"
SNAP_SQL = f"""select * from (select asset, contract_symbol, expiry_year, expiry_code, m, max(date) as last_price_date, arg_max(close, date) as close
  from contracts where volume>0 and date<=date '{AS_OF}' group by asset, contract_symbol, expiry_year, expiry_code, m) where last_price_date>=date '{AS_OF}'-10"""


@query("curve_snapshot_active", "C5 F15", f"select asset, contract_symbol, expiry_year, expiry_code, last_price_date, close from ({SNAP_SQL})")
def _(spark, d):
    return op.curve_snapshot(dv.contracts(spark, d), AS_OF)


@query("curve_shape_latest", "C6", f"""select asset, count(*) as n_contracts, arg_min(close,m) as front_close, arg_max(close,m) as back_close,
 case when count(*)<2 then 'single' when arg_max(close,m)>arg_min(close,m) then 'contango' else 'backwardation' end as curve_shape from ({SNAP_SQL}) group by asset""")
def _(spark, d):
    return op.curve_shape(op.curve_snapshot(dv.contracts(spark, d), AS_OF), ["asset"])


@query("curve_shape_history", "C7", """select asset, date, count(*) as n_contracts, arg_min(close,m) as front_close, arg_max(close,m) as back_close,
 case when arg_max(close,m)>arg_min(close,m) then 'contango' else 'backwardation' end as curve_shape, round((arg_max(close,m)/arg_min(close,m)-1)*100,4) as steepness_pct
 from contracts where volume>0 group by asset, date having count(*)>=2""")
def _(spark, d):
    return op.shape_history(dv.contracts(spark, d)).withColumn("steepness_pct", F.round("steepness_pct", 4))


@query("curve_rank_history", "C8", """select asset, date, rank, contract_symbol, close, round(close-fc,6) as close_minus_front from (select *, row_number() over w - 1 as rank, first_value(close) over w as fc
 from contracts where volume>0 window w as (partition by asset, date order by m)) where rank<10""")
def _(spark, d):
    return op.rank_history(dv.contracts(spark, d)).withColumn("close_minus_front", F.round("close_minus_front", 6))


@query("contango_share", "C9", """select asset, round(avg(case when b>f then 1.0 else 0.0 end),6) as share from (select asset, date, arg_max(close,m) as b, arg_min(close,m) as f
 from contracts where volume>0 group by asset, date having count(*)>=2) group by asset""")
def _(spark, d):
    h = op.shape_history(dv.contracts(spark, d))
    return rounded(h.groupBy("asset").agg(F.avg((F.col("curve_shape") == "contango").cast("double")).alias("share")))


@query("combos_by_volume", "C10", """select near_contract_symbol || ' / ' || far_contract_symbol as legs, asset, sum(volume) as volume from quotes group by 1, 2""")
def _(spark, d):
    s = dv.spreads(dv.contracts(spark, d)).groupBy(F.concat_ws(" / ", "near_contract_symbol", "far_contract_symbol").alias("legs"), "asset").agg(F.sum("volume").alias("volume"))
    return s.orderBy(F.desc("volume"), "legs", "asset")


@query("price_richness", "C11", """with l as (select asset, spread_symbol, count(close) as n_obs, arg_max(close,date) as latest, avg(close) as mu, stddev_samp(close) as s from quotes group by all)
select l.asset, l.spread_symbol, n_obs, case when n_obs>=20 then round(avg(case when close<=latest then 100.0 else 0 end),4) end as percentile,
 case when n_obs>=20 and s>0 then round((latest-mu)/s,5) end as zscore from quotes q join l on q.asset=l.asset and q.spread_symbol=l.spread_symbol group by l.asset, l.spread_symbol, n_obs, latest, mu, s""")
def _(spark, d):
    return rounded(op.richness(materialize(dv.spreads(dv.contracts(spark, d)), "quotes"), ["asset", "spread_symbol"], "close"), 5, percentile=4)


cte("carry_w", """select p.asset, p.sector, p.date, p.close, c.carry from panel_w p left join (select asset, date + cast((12-dayofweek(date))%7 as integer) as week,
  arg_max(carry, date) as carry from proxy_d where carry is not null group by 1, 2) c on p.asset=c.asset and p.date=c.week""")


def carry_w(spark, d):
    """Weekly panel with the last proxy carry of each week."""
    c, _, f = curve_inputs(spark, d)
    c = op.proxy_carry(f, c)
    wk = c.groupBy("asset", week_end("date").alias("date")).agg(F.max_by("carry", "date").alias("carry"))
    return mk.panel_w(spark, d).select("asset", "sector", "date", "close").join(wk, ["asset", "date"], "left")


@query("weekly_carry_panel", "J8", "select asset, sector, date, round(carry,6) as carry from carry_w")
def _(spark, d):
    return rounded(carry_w(spark, d).select("asset", "sector", "date", "carry"))
