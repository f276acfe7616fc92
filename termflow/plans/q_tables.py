"""Universe filters, as-of lookups, landed files, sinks and monitoring."""
import datetime as dt

from pyspark.sql import functions as F

from termflow.functions.cols import rounded
from termflow.operators import asof, monitor, universe as op
from termflow.plans.registry import cte, query
from termflow.session import materialize, scratch_path
from termflow.sources import driver_views as dv, market as mk, readers, sinks
from termflow.streaming import ingest as ing

# ---- universe


def nations(spark, d):
    return dv.table(spark, d, "nation").select(F.col("n_name").alias("asset"), "n_nationkey", "n_regionkey")


@query("liquid_universe", "F10", """select asset, round(adv,4) as adv, adv>=175 and asset not in ('NATION_3','NATION_8') as included from (select asset, avg(volume) as adv from bars_w where date>=date '2000-01-01' group by asset)""")
def _(spark, d):
    return rounded(op.liquid_universe(dv.bars_w(spark, d), "2000-01-01", 175.0, nations(spark, d).where("n_nationkey in (3, 8)")), 4)


@query("universe_compression_by_family", "F11", """select asset, 'trend' as family from (select distinct asset from bars_w) where regexp_extract(asset,'[0-9]+')::int%5<>0
 union all select asset, 'rank' from (select distinct asset from bars_w) where regexp_extract(asset,'[0-9]+')::int%10<>0""")
def _(spark, d):
    u = dv.bars_w(spark, d).select("asset").distinct()
    red = nations(spark, d).where("n_nationkey % 5 = 0").select("asset", F.when(F.col("n_nationkey") % 10 == 0, "all").otherwise("trend").alias("scope"))
    return op.compress(u, red, "trend").withColumn("family", F.lit("trend")).unionByName(op.compress(u, red, "rank").withColumn("family", F.lit("rank")))


def since(spark, d):
    return nations(spark, d).where("n_nationkey % 3 = 0").select("asset", F.make_date(F.lit(1996) + F.col("n_nationkey") % 4, F.lit(6), F.lit(1)).alias("trusted_since"))


@query("trusted_era_mask", "F9", """select p.asset, date, case when regexp_extract(p.asset,'[0-9]+')::int%3<>0 or date>=make_date(1996+regexp_extract(p.asset,'[0-9]+')::int%4,6,1) then close end as close from panel_w p""")
def _(spark, d):
    return op.mask_untrusted(mk.panel_w(spark, d), since(spark, d), ["close"]).select("asset", "date", "close")


@query("bad_print_patch", "S3", """select asset, date, case when asset='NATION_2' and date=(select max(date) from bars_w) then null else close end as close from panel_w""")
def _(spark, d):
    p = mk.panel_w(spark, d)
    last = dv.bars_w(spark, d).agg(F.max("date").alias("date"))
    bad = last.withColumn("asset", F.lit("NATION_2"))
    return readers.mask_bad_prints(p, bad, ["close"]).select("asset", "date", "close")


@query("active_asset_gate", "F12", """select asset, count(signal) as n_alpha, round(count(ret)/count(*),6) as coverage from sig_w group by asset having count(signal)>0 and count(ret)/count(*)>=0.95""")
def _(spark, d):
    return rounded(op.active_assets(mk.sig_w(spark, d), "signal", "ret", 0.95))


@query("sector_lookup", "F13", "select asset, sector, count(*) as bars from bars_w group by asset, sector")
def _(spark, d):
    sec = dv.assets(spark, d).select("asset", "sector").distinct()
    return op.with_sector(dv.bars_w(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("bars")), sec)


cte("pcorr", """select a.sector, a.asset as asset_a, b.asset as asset_b, case when stddev_samp(a.ret)*stddev_samp(b.ret)>0 then covar_samp(a.ret,b.ret)/(stddev_samp(a.ret)*stddev_samp(b.ret)) end as corr, count(*) as n
 from ret_w a join ret_w b on a.sector=b.sector and a.date=b.date and a.asset<b.asset where a.date<=date '1999-12-31' and a.ret is not null and b.ret is not null group by all""")


def pair_corr(spark, d):
    return op.sector_correlations(mk.ret_w(spark, d), "ret", "1999-12-31")


@query("sector_pair_correlations", "P13", "select sector, asset_a, asset_b, round(corr,6) as corr, n from pcorr")
def _(spark, d):
    return rounded(pair_corr(spark, d))


@query("flagged_redundant_pairs", "J19 J20", """select sector, asset_a, asset_b, round(corr,6) as corr, case when corr>=0.1 then 'near_duplicate' else 'directional' end as tier,
 case when coalesce(a.adv>=b.adv,true) then asset_a else asset_b end as keep, case when coalesce(a.adv>=b.adv,true) then asset_b else asset_a end as "drop"
 from pcorr left join adv_w a on a.asset=asset_a left join adv_w b on b.asset=asset_b where corr>=0.02""")
def _(spark, d):
    f = op.keep_liquid_leg(op.flagged_pairs(pair_corr(spark, d), 0.1, 0.02), op.liquid_universe(dv.bars_w(spark, d), "1999-01-01"))
    return rounded(f.select("sector", "asset_a", "asset_b", "corr", "tier", "keep", "drop"))


@query("sector_coverage_check", "J21", """select sector, count(*) as members, count(*) filter (where regexp_extract(asset,'[0-9]+')::int%5<>0) as kept, count(*) filter (where regexp_extract(asset,'[0-9]+')::int%5<>0)>=2 as ok from (select distinct asset, sector from sup) group by sector""")
def _(spark, d):
    sec = dv.assets(spark, d).select("asset", "sector").distinct()
    return op.sector_coverage(sec, nations(spark, d).where("n_nationkey % 5 <> 0"))


@query("session_gap_coverage", "J18", """with span as (select asset, min(date) as start, max(date) as "end", count(*) as rows from bars_d group by asset), cal as (select distinct date from bars_d)
select s.asset, s.start, s."end", s.rows, count(*) as expected, count(*)-count(b.date) as missing, round((count(*)-count(b.date))/count(*),6) as missing_pct from span s join cal on cal.date between s.start and s."end"
 left join bars_d b on b.asset=s.asset and b.date=cal.date group by all""")
def _(spark, d):
    b = dv.bars_d(spark, d).select("asset", "date", F.lit("all").alias("calendar"))
    return rounded(op.session_gaps(b, b.select("calendar", "date").distinct()))


@query("date_range_presets", "F18", """select '1Y' as preset, count(*) as n from macro where date>=(select max(date) from macro)-interval 12 month union all select '5Y', count(*) from macro where date>=(select max(date) from macro)-interval 60 month
 union all select 'max', count(*) from macro union all select 'custom', count(*) from macro where date between date '1997-01-01' and date '1998-06-30'""")
def _(spark, d):
    m = dv.macro(spark, d).withColumnRenamed("ref_date", "date")
    out = None
    for p in ("1Y", "5Y", "max", "custom"):
        x = op.date_range_preset(m, p, "1997-01-01", "1998-06-30").groupBy(F.lit(p).alias("preset")).agg(F.count(F.lit(1)).alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


# ---- as-of

OB = "case dayofweek(make_date(y,{m},{d})) when 6 then make_date(y,{m},{d})-1 when 0 then make_date(y,{m},{d})+1 else make_date(y,{m},{d}) end"
NTH = "make_date(y,{m},1)+cast(({w}-dayofweek(make_date(y,{m},1))+7)%7+7*({n}-1) as integer)"
cte("hol", "select unnest([" + ", ".join(
    [OB.format(m=1, d=1), NTH.format(m=1, w=1, n=3), NTH.format(m=2, w=1, n=3), "make_date(y,5,31)-cast((dayofweek(make_date(y,5,31))+6)%7 as integer)",
     OB.format(m=7, d=4), NTH.format(m=9, w=1, n=1), NTH.format(m=10, w=1, n=2), OB.format(m=11, d=11), NTH.format(m=11, w=4, n=4), OB.format(m=12, d=25)]) + "]) as h from (select unnest(range((select year(min(date))-1 from macro)::bigint, (select year(max(date))+3 from macro)::bigint)) as y)")
cte("bday", """select date, b, sum(b) over (order by date) as k from (select cast(r as date) as date, case when dayofweek(r) in (0,6) or cast(r as date) in (select h from hol) then 0 else 1 end as b
  from (select unnest(generate_series((select date_trunc('year',min(date))-interval 1 year from macro)::timestamp, (select date_trunc('year',max(date))+interval 2 year-interval 1 day from macro)::timestamp, interval 1 day)) as r))""")
cte("pubd", """select m.series, m.date as ref_date, m.value, t.date as publish_date from macro m join bday s on s.date=m.date join bday t on t.b=1 and t.k=s.k+1""")
cte("pubm", """select m.series, m.date as ref_date, m.value, t.date as publish_date from (select series, cast(date_trunc('month',date) as date) as date, sum(value) as value from macro group by 1,2) m
  join bday s on s.date=cast(m.date+interval 1 month as date) join bday t on t.b=1 and t.k=s.k+6""")


def wk_dates(spark, d):
    return dv.bars_w(spark, d).select("date").distinct()


def bcal(spark, d):
    return asof.calendar_of(dv.macro(spark, d), "ref_date")


@query("business_day_publication", "J12", "select series, ref_date, publish_date from pubd")
def _(spark, d):
    return asof.publish(dv.macro(spark, d), "ref_date", "business_days", bcal(spark, d), 1).select("series", "ref_date", "publish_date")


def asof_sql(pub, on):
    return f"""select a.asset, a.date, p.ref_date, round(p.value,2) as value from (select distinct asset, date, (['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'])[1+regexp_extract(asset,'[0-9]+')::int%5] as series from bars_w) a
 left join lateral (select ref_date, value from {pub} p where p.series=a.series and p.{on}<=a.date order by ref_date desc limit 1) p on true"""


def with_series(spark, d):
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    b = dv.bars_w(spark, d).select("asset", "date")
    return b.withColumn("series", F.get(names, F.element_at(F.split("asset", "_"), -1).cast("int") % 5))


def asof_query(spark, d, pub):
    j = asof.asof_join(with_series(spark, d), pub, "series", "date", "publish_date", ["ref_date", "value"], "ref_date")
    return rounded(j.select("asset", "date", "ref_date", "value"), 2)


@query("asof_same_day", "J11", asof_sql("(select *, date as ref_date from macro)", "ref_date"))
def _(spark, d):
    return asof_query(spark, d, asof.publish(dv.macro(spark, d), "ref_date", "same_day", None))


@query("asof_business_day_lag", "J12", asof_sql("pubd", "publish_date"))
def _(spark, d):
    return asof_query(spark, d, asof.publish(dv.macro(spark, d), "ref_date", "business_days", bcal(spark, d), 1))


@query("asof_next_month_lag", "J13", asof_sql("pubm", "publish_date"))
def _(spark, d):
    m = dv.macro(spark, d).groupBy("series", F.trunc("ref_date", "MM").alias("ref_date")).agg(F.sum("value").alias("value"))
    return asof_query(spark, d, asof.publish(m, "ref_date", "next_month", bcal(spark, d), 6))


cte("regime_x", """select date, case when close<=(select quantile_cont(close,1/3) from vix_w) then 'low' when close<=(select quantile_cont(close,2/3) from vix_w) then 'mid' else 'high' end as regime from vix_w""")
cte("act_x", """select d.date, b.book, r.regime, coalesce(a.active, true) as active, coalesce(a.m, 1.0)::double as alpha_multiplier from (select distinct date+1 as date from bars_w) d cross join (select r_name as book from region) b
 asof left join regime_x r on r.date<=d.date left join (values ('AFRICA','high',false,0.0),('AFRICA','mid',true,0.5),('ASIA','low',true,2.0)) a(book, regime, active, m) on a.book=b.book and a.regime=r.regime""")


def actions(spark, d):
    """Action table rows keyed by region and regime."""
    r = dv.table(spark, d, "region").select(F.col("r_name").alias("book"))
    def act(regime, active, m):
        return F.struct(F.lit(regime).alias("regime"), F.lit(active).alias("active"), F.lit(m).alias("alpha_multiplier"))

    rows = F.when(F.col("book") == "AFRICA", F.array(act("high", False, 0.0), act("mid", True, 0.5))).when(
        F.col("book") == "ASIA", F.array(act("low", True, 2.0)))
    return r.select("book", F.explode(rows).alias("a")).select("book", "a.*")


def regime_acts(spark, d):
    books = dv.table(spark, d, "region").select(F.col("r_name").alias("book"))
    dates = wk_dates(spark, d).select(F.date_add("date", 1).alias("date"))
    reg = dv.regime(spark, d).withColumnRenamed("date", "date_r")
    return asof.regime_actions(dates, reg, actions(spark, d), books)


@query("regime_actions_asof", "J14", "select * from act_x")
def _(spark, d):
    return regime_acts(spark, d)


@query("regime_applied_alpha", "J15", """select s.asset, s.date+1 as date, s.sector as book, round(signal*coalesce(alpha_multiplier,1),6) as alpha from sig_w s left join act_x a on a.date=s.date+1 and a.book=s.sector where coalesce(active,true)""")
def _(spark, d):
    a = mk.sig_w(spark, d).select("asset", F.date_add("date", 1).alias("date"), F.col("sector").alias("book"), F.col("signal").alias("alpha"))
    return rounded(asof.apply_regime(a, regime_acts(spark, d)).select("asset", "date", "book", "alpha"))


# ---- landed files and sinks

@query("dated_raw_files", "S2", """select cast(ts as date) as date, event_type, count(*) as n, round(sum(value),4) as total from events group by 1, 2""")
def _(spark, d):
    e = dv.table(spark, d, "events")
    path = scratch_path(spark, "raw")
    e.select("event_id", F.col("event_type"), "value", F.date_format("ts", "yyyyMMdd").alias("day")).write.partitionBy("day").option("header", True).csv(path)
    r = readers.dated_csv(spark, path + "/*", "event_id long, event_type string, value double", r"day=(\d{8})", ["event_type", "value"])
    return rounded(r.groupBy("date", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


SER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("wide_series_csv", "S8", "select date, series, round(value,2) as value from macro union all select d.date, s.series, null from (select distinct date from macro) d cross join (select distinct series from macro) s where not exists (select 1 from macro m where m.date=d.date and m.series=s.series)")
def _(spark, d):
    path = scratch_path(spark, "wide")
    m = dv.macro(spark, d).groupBy(F.col("ref_date").alias("Date")).pivot("series", SER).agg(F.max("value"))
    sinks.export(m, path, "csv")
    return rounded(readers.wide_series_csv(spark, path, tuple(SER)), 2)


@query("bounded_publisher_fill", "S9", """select series, date, last_value(v ignore nulls) over (partition by series order by date rows between 2 preceding and current row) as value from (
 select series, date, case when (month(date)-1)%3=0 then value end as v from (select series, cast(date_trunc('month',date) as date) as date, round(sum(value),2) as value from macro group by 1, 2))""")
def _(spark, d):
    m = dv.macro(spark, d).groupBy("series", F.trunc("ref_date", "MM").alias("date")).agg(F.round(F.sum("value"), 2).alias("value"))
    return readers.fill_publishers(m.withColumn("value", F.when((F.month("date") - 1) % 3 == 0, F.col("value"))))


@query("rate_type_last_duplicate", "S10", "select cast(o_orderdate as date) as date, round(arg_max(o_totalprice, o_orderkey),2) as rate from orders where o_orderpriority='2-HIGH' group by 1")
def _(spark, d):
    r = dv.table(spark, d, "orders").select(F.col("o_orderpriority").alias("rate_type"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("rate"), F.col("o_orderkey").alias("arrival"))
    return rounded(readers.rate_series(r, "2-HIGH"), 2)


@query("rate_type_pivot", "M3", "select cast(o_orderdate as date) as date, " + ", ".join(f"""round(arg_max(o_totalprice, o_orderkey) filter (where o_orderpriority='{s}'),2) as "{s}" """ for s in SER) + " from orders group by 1")
def _(spark, d):
    r = dv.table(spark, d, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderkey")
    return rounded(readers.pivot_last(r, "date", "o_orderpriority", SER, "o_totalprice", "o_orderkey"), 2)


@query("date_from_parts", "S11", "select date, series, round(value,2) as value from macro")
def _(spark, d):
    m = dv.macro(spark, d).select("series", "value", F.year("ref_date").alias("year"), F.month("ref_date").alias("month"), F.dayofmonth("ref_date").alias("day"))
    return rounded(readers.dated_parts(m), 2)


@query("trusted_since_csv", "S12", "select n_name as asset, make_date(1996+n_nationkey%4,6,1) as trusted_since from nation where n_nationkey%3=0")
def _(spark, d):
    path = scratch_path(spark, "trusted")
    sinks.export(since(spark, d), path, "csv")
    return readers.trusted_since(spark, path)


@query("daily_to_monthly_mean", "S13", "select * from (select cast(date_trunc('month',date) as date) as date, " + ", ".join(f"""round(avg(value) filter (where series='{s}'),6) as "{s}" """ for s in SER) + " from macro group by 1) where " + " and ".join(f'"{s}" is not null' for s in SER))
def _(spark, d):
    w = dv.macro(spark, d).groupBy(F.col("ref_date").alias("date")).pivot("series", SER).agg(F.max("value"))
    return rounded(readers.monthly_mean(w, SER))


@query("outer_joined_series", "S14", "select date, " + ", ".join(f"""round(max(value) filter (where series='{s}'),6) as "{s}" """ for s in SER) + " from macro group by date")
def _(spark, d):
    return rounded(readers.outer_series(dv.macro(spark, d).withColumnRenamed("ref_date", "date"), SER), 2)


@query("upsert_last_wins", "S15 S16", """select asset, date, case when date>=date '2000-01-07' then close+1 else close end as close from bars_w""")
def _(spark, d):
    b = dv.bars_w(spark, d).select("asset", "date", "close")
    root = scratch_path(spark, "upsert")
    sinks.upsert(b.where("date < '2000-06-01'"), root, ["asset", "date"], False)
    return sinks.upsert(b.where("date >= '2000-01-07'").withColumn("close", F.col("close") + 1), root, ["asset", "date"], True)


@query("upsert_touched_partitions", "S15 W1", """with p as (select asset, date, close, '2000-03-31' as cycle from bars_w where date<=date '2000-03-31' union all
 select asset, date, close+1, '2000-06-02' from bars_w where date>=date '2000-03-10' and date<=date '2000-06-05')
select asset, date, arg_max(close, cycle) as close, max(cycle) as cycle, date_trunc('month', date)<date '2000-03-01' as kept from p group by 1, 2""")
def _(spark, d):
    """Two weekly refreshes with an overlap: the second brings corrections and rewrites only the months it touches."""
    b = dv.bars_w(spark, d).select("asset", "date", "close")
    t = sinks.PartitionedTable(scratch_path(spark, "monthly"), ["asset", "date"], F.date_format("date", "yyyy-MM"))
    day = dt.date
    first = ing.pull(b, day(1970, 1, 1), 0, day(2000, 3, 31))
    t.upsert(first.withColumn("seq", F.lit(0)), 1, "seq")
    before = materialize(t.read(spark).select("asset", "date", F.input_file_name().alias("file")), "files-before")
    again = ing.pull(b.withColumn("close", F.col("close") + 1), day(2000, 3, 31), 21, day(2000, 6, 5)).withColumn("seq", F.lit(0))
    t.upsert(again, 2, "seq")
    t.upsert(again, 2, "seq")  # replayed
    now = t.read(spark).withColumn("now", F.input_file_name())
    return now.join(before, ["asset", "date"], "left").select("asset", "date", "close", "cycle", F.coalesce(F.col("now") == F.col("file"), F.lit(False)).alias("kept"))


@query("manifest_append", "S17", """select run_id, status, count(*) as n from (select r.run_id, asset, case when count(*)<340 then 'PARTIAL' else 'OK' end as status from bars_w cross join (values ('a'),('b')) r(run_id) group by 1, 2) group by 1, 2""")
def _(spark, d):
    st = dv.bars_w(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("rows_read")).withColumn("status", F.when(F.col("rows_read") < 340, "PARTIAL").otherwise("OK"))
    root = scratch_path(spark, "audit")
    sinks.append_audit(st, root, "a")
    return sinks.append_audit(st, root, "b").groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("result_sinks_roundtrip", "S18", "select fmt, count(*) as n, round(sum(pnl),4) as total from pnl_w cross join (values ('csv'),('parquet'),('json')) f(fmt) group by fmt")
def _(spark, d):
    p = mk.pnl_w(spark, d)
    out = None
    for fmt in ("csv", "parquet", "json"):
        path = scratch_path(spark, fmt)
        sinks.export(p, path, fmt)
        r = spark.read.schema("date date, pnl double")
        x = (r.option("header", True) if fmt == "csv" else r).format(fmt).load(path).groupBy(F.lit(fmt).alias("fmt")).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total"))
        out = x if out is None else out.unionByName(x)
    return rounded(out, 4)


# ---- monitoring

@query("pipeline_health", "M1", """with m as (select o_orderpriority as job, cast(o_orderdate as date) as run_date, case when o_orderkey%7=0 then 'ERROR' else 'OK' end as status from orders),
l as (select job, max(run_date) as run_date from m group by job), g as (select m.job, m.run_date as last_run, count(*) as items, count(*) filter (where status='OK') as ok, count(*) filter (where status='ERROR') as failed from m join l on m.job=l.job and m.run_date=l.run_date group by 1, 2)
select *, case when last_run<timestamp '2001-08-02 12:00:00'-interval 48 hour then 'STALE' when failed=items then 'FAILED' when ok<items then 'PARTIAL' else 'OK' end as status from g""")
def _(spark, d):
    m = dv.table(spark, d, "orders").select(F.col("o_orderpriority").alias("job"), F.to_date("o_orderdate").alias("run_date"), F.when(F.col("o_orderkey") % 7 == 0, "ERROR").otherwise("OK").alias("status"))
    return monitor.pipeline_health(m, "2001-08-02 12:00:00")


@query("macro_latest_snapshot", "M2", """with v as (select series as source, ref_date, publish_date, value from pubd union all select 'monthly ' || series, ref_date, publish_date, value from pubm)
select source, max(ref_date) filter (where publish_date<=date '2000-03-07') as value_date, round(arg_max(value, ref_date) filter (where publish_date<=date '2000-03-07'),2) as value,
 case when count(*) filter (where publish_date<=date '2000-03-07')>0 then 'OK' else 'NO_DATA_AVAILABLE' end as data_status, case when source like 'monthly%' then 'UNKNOWN' else 'OK' end as job_status from v group by source""")
def _(spark, d):
    cal = bcal(spark, d)
    a = asof.publish(dv.macro(spark, d), "ref_date", "business_days", cal, 1).withColumnRenamed("series", "source")
    m = dv.macro(spark, d).groupBy("series", F.trunc("ref_date", "MM").alias("ref_date")).agg(F.sum("value").alias("value"))
    b = asof.publish(m, "ref_date", "next_month", cal, 6).withColumn("source", F.concat(F.lit("monthly "), "series")).drop("series")
    man = dv.table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.to_date("o_orderdate").alias("run_date"), F.lit("OK").alias("status")).distinct()
    return rounded(monitor.macro_latest(a.unionByName(b), "2000-03-07", man), 2)


# ---- stream alignment

@query("outer_aligned_streams", "J16", """select date, round(sum(w*pnl),6) as pnl from (select date, 0.5 as w, gross as pnl from spec_pnl where spec='4' and date<date '2000-01-01' union all select date, 0.3, gross from spec_pnl where spec='12' and date>=date '1998-01-01'
  union all select date, 0.2, gross from spec_pnl where spec='26') group by date""")
def _(spark, d):
    from termflow.operators.risk import combine_static
    from termflow.plans.q_backtest import spec_pnl
    s = spec_pnl(spark, d).select(F.col("spec").alias("stream"), "date", F.col("gross").alias("pnl"))
    s = s.where("(stream = '4' and date < '2000-01-01') or (stream = '12' and date >= '1998-01-01') or stream = '26'")
    return rounded(combine_static(s, {"4": 0.5, "12": 0.3, "26": 0.2}))
