"""Raw bars, definitions and multi-leg symbols derived from the line items and parts."""
from pyspark.sql import functions as F

from termflow.functions.calendar import month_code
from termflow.functions.cols import rounded
from termflow.operators import combos, ingest as op
from termflow.plans.registry import cte, query
from termflow.sources import driver_views as dv

# Raw rows: instrument = part, one bar per (part, day), prices in 1e-9 units; some bars carry the
# undefined marker, some an exact zero, some are inverted.
cte("raw_bars", """select date, instrument_id, case when vol=7 then 9223372036854775807 else lo*10000000 end as open, case when vol=11 then 1 else hi*10000000 end as high,
  case when vol=13 then 0 when vol=17 then -lo*10000000 else lo*10000000 end as low, hi*10000000 as close, case when vol=19 then 0 else vol end as volume
 from (select cast(l_shipdate as date) as date, l_partkey as instrument_id, min(cast(floor(l_extendedprice*100+0.5) as bigint)) as lo, max(cast(floor(l_extendedprice*100+0.5) as bigint)) as hi,
  cast(sum(l_quantity) as bigint) as vol from lineitem group by 1, 2)""")
cte("defs", """select date, arrival, instrument_id, r as asset, r as root, instrument_class, my as maturity_year, mm as maturity_month,
 case when instrument_class<>'S' then r || c1 || y1 || case when instrument_id%5=0 then '_Z' else '' end
  when g=0 then c1||y1||'-'||c2||y2 when g=1 then r||c1||y1||'-'||'N9'||c2||y2 when g=2 then c1||yy1||'-'||c2||yy2 when g=3 then r||':N8 '||c1||y1||'-'||c2||y2
  when g=4 then r||':C1 N8-N9 '||c1||y1 when g=5 then r||':C1 N8 '||c1||y1||'-N9 '||c2||y2 when g=6 then r||':BF '||c1||y1||'-'||c2||y2||'-'||c3||y3
  when g=7 then r||':BB '||c1||y1||'-'||c1||y2||'-'||c1||y3 when g=8 then r||':CF '||c1||y1||c2||y2||c3||y3||c1||y3 when g=9 then r||':DF '||c1||y1||c2||y1||c3||y2||c1||y2
  when g=10 then r||':AB '||cast(p_size%5+1 as varchar)||'Y '||c1||y1 when g=11 then r||':SB PK '||c1||y1||'-'||c2||y2 when g=12 then 'UD:1N: '||c1||y1
  when g=13 then c1||y1||'-'||c2||y2||'-'||c3||y3 when g=14 then 'ZZ'||c1||y1||'-'||c2||y2 else c3||y3||'-'||c3||y2 end as raw_symbol
 from (select *, case when g=11 and p_size%2=0 then 'SR3' else 'N' || cast(instrument_id%25 as varchar) end as r,
   substr('FGHJKMNQUVXZ', mm, 1) as c1, substr('FGHJKMNQUVXZ', 1+(mm+1)%12, 1) as c2, substr('FGHJKMNQUVXZ', 1+(mm+4)%12, 1) as c3,
   cast(my%10 as varchar) as y1, cast((my+1)%10 as varchar) as y2, cast((my+2)%10 as varchar) as y3, lpad(cast(my%100 as varchar),2,'0') as yy1, lpad(cast((my+1)%100 as varchar),2,'0') as yy2
  from (select date, arrival, instrument_id, p_size, case when p_size%3=0 then 'F' when p_size%3=1 then 'S' else 'X' end as instrument_class, cast(year(date)+(p_size%2) as integer) as my,
    cast(1+(month(date)+p_size)%12 as integer) as mm, instrument_id%16 as g
   from (select cast(l_shipdate as date) as date, l_orderkey*8+l_linenumber as arrival, l_partkey as instrument_id, p_size from lineitem join part on l_partkey=p_partkey where l_quantity<20)))""")


def raw_bars(spark, d):
    li = dv.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("instrument_id"),
                                               dv.cents("l_extendedprice").alias("px"), "l_quantity")
    b = li.groupBy("date", "instrument_id").agg(F.min("px").alias("lo"), F.max("px").alias("hi"), F.sum("l_quantity").cast("long").alias("vol"))
    s, v = F.lit(10_000_000), F.col("vol")
    return b.select("date", "instrument_id", F.when(v == 7, F.lit(op.UNDEF_PRICE)).otherwise(F.col("lo") * s).alias("open"),
                    F.when(v == 11, F.lit(1)).otherwise(F.col("hi") * s).alias("high"),
                    F.when(v == 13, F.lit(0)).when(v == 17, -F.col("lo") * s).otherwise(F.col("lo") * s).alias("low"),
                    (F.col("hi") * s).alias("close"), F.when(v == 19, F.lit(0)).otherwise(v).alias("volume"))


def definitions(spark, d):
    """Definition events: several grammars per root, republished on the days a part ships small lots."""
    li = dv.table(spark, d, "lineitem").where("l_quantity < 20").select(
        F.to_date("l_shipdate").alias("date"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("arrival"), F.col("l_partkey").alias("instrument_id"))
    x = li.join(dv.table(spark, d, "part").select(F.col("p_partkey").alias("instrument_id"), "p_size"), "instrument_id")
    i, z = F.col("instrument_id"), F.col("p_size")
    x = (x.withColumn("my", F.year("date") + z % 2).withColumn("mm", 1 + (F.month("date") + z) % 12).withColumn("g", (i % 16).cast("int"))
         .withColumn("instrument_class", F.when(z % 3 == 0, "F").when(z % 3 == 1, "S").otherwise("X")))
    r = F.when((F.col("g") == 11) & (z % 2 == 0), "SR3").otherwise(F.concat(F.lit("N"), (i % 25).cast("string")))
    x = x.withColumn("root", r)
    m, y = F.col("mm"), F.col("my")
    c1, c2, c3 = month_code(m), month_code(1 + (m + 1) % 12), month_code(1 + (m + 4) % 12)
    y1, y2, y3 = (((y + k) % 10).cast("string") for k in range(3))
    yy1, yy2 = (F.lpad(((y + k) % 100).cast("string"), 2, "0") for k in range(2))
    root = F.col("root")

    def cat(*p):
        return F.concat(*[F.lit(q) if isinstance(q, str) else q for q in p])

    forms = [
        cat(c1, y1, "-", c2, y2), cat(root, c1, y1, "-N9", c2, y2), cat(c1, yy1, "-", c2, yy2), cat(root, ":N8 ", c1, y1, "-", c2, y2),
        cat(root, ":C1 N8-N9 ", c1, y1), cat(root, ":C1 N8 ", c1, y1, "-N9 ", c2, y2), cat(root, ":BF ", c1, y1, "-", c2, y2, "-", c3, y3),
        cat(root, ":BB ", c1, y1, "-", c1, y2, "-", c1, y3), cat(root, ":CF ", c1, y1, c2, y2, c3, y3, c1, y3), cat(root, ":DF ", c1, y1, c2, y1, c3, y2, c1, y2),
        cat(root, ":AB ", (z % 5 + 1).cast("string"), "Y ", c1, y1), cat(root, ":SB PK ", c1, y1, "-", c2, y2), cat("UD:1N: ", c1, y1),
        cat(c1, y1, "-", c2, y2, "-", c3, y3), cat("ZZ", c1, y1, "-", c2, y2), cat(c3, y3, "-", c3, y2)]
    sym = F.when(F.col("instrument_class") != "S", cat(root, c1, y1, F.when(i % 5 == 0, "_Z").otherwise("")))
    for k, f in enumerate(forms):
        sym = sym.when(F.col("g") == k, f)
    return x.select("date", "arrival", "instrument_id", root.alias("asset"), "root", "instrument_class", y.alias("maturity_year"), m.alias("maturity_month"), sym.alias("raw_symbol"))


cte("defs1", "select * from (select *, row_number() over (partition by date, instrument_id order by arrival) as k from defs) where k=1")
cte("defined", """select b.*, case when e.raw_symbol is not null then 'exact' when f.raw_symbol is not null then 'fallback' else 'none' end as match, f.asset, f.root, f.instrument_class, f.maturity_year, f.maturity_month, f.raw_symbol
 from raw_bars b left join defs1 e on e.instrument_id=b.instrument_id and e.date=b.date asof left join defs1 f on f.instrument_id=b.instrument_id and f.date<=b.date""")
cte("clean", """select * from (select date, instrument_id, open/1e9 as open, high/1e9 as high, low/1e9 as low, close/1e9 as close, volume, asset, root, raw_symbol, maturity_year, maturity_month,
  case instrument_class when 'F' then 'outright' when 'S' then 'combo' else 'other' end as kind from defined where raw_symbol is not null and 9223372036854775807 not in (open, high, low, close))
 where not (kind='outright' and ((asset in ('N5','N10') and raw_symbol like '%\\_Z' escape '\\') or 0 in (open, high, low, close)))""")
def ice():
    return F.col("asset").isin("N5", "N10")


def defined(spark, d):
    return op.define_bars(raw_bars(spark, d), definitions(spark, d))


def clean(spark, d):
    return op.clean_rows(defined(spark, d), ice())


@query("definition_dedup", "J1", "select date, instrument_id, raw_symbol, maturity_year, maturity_month from defs1")
def _(spark, d):
    return op.dedup_definitions(definitions(spark, d)).select("date", "instrument_id", "raw_symbol", "maturity_year", "maturity_month")


@query("definition_join_with_fallback", "J2", "select date, instrument_id, close, match, raw_symbol from defined")
def _(spark, d):
    return defined(spark, d).select("date", "instrument_id", "close", "match", "raw_symbol")


@query("clean_scaled_rows", "F1 F2 F3 F4 F5", "select date, instrument_id, round(open,2) as open, round(high,2) as high, round(low,2) as low, round(close,2) as close, volume, kind from clean")
def _(spark, d):
    return rounded(clean(spark, d).select("date", "instrument_id", "open", "high", "low", "close", "volume", "kind"), 2)


@query("outright_quality_counters", "F6", """select asset, count(*) as outright_rows, count(*) filter (where open<=0 or high<=0 or low<=0 or close<=0) as non_positive_price_rows,
 count(*) filter (where volume=0) as zero_volume_outright_rows, count(*) filter (where high<low or high<open or high<close or low>open or low>close) as ohlc_violation_rows from clean where kind='outright' group by asset""")
def _(spark, d):
    return op.quality_counters(clean(spark, d).where("kind = 'outright'"), ["asset"])


@query("outright_contract_symbols", "F7", """select date, instrument_id, asset, root || substr('FGHJKMNQUVXZ', maturity_month, 1) || lpad(cast(maturity_year%100 as varchar),2,'0') || '.X' as contract_symbol,
 maturity_year as expiry_year, substr('FGHJKMNQUVXZ', maturity_month, 1) as expiry_code from clean where kind='outright'""")
def _(spark, d):
    x = clean(spark, d).where("kind = 'outright'").withColumn("exchange", F.lit("X")).withColumn("expiry_code", month_code("maturity_month"))
    return x.select("date", "instrument_id", "asset", op.contract_symbol("root", "expiry_code", "maturity_year", "exchange").alias("contract_symbol"),
                    F.col("maturity_year").alias("expiry_year"), "expiry_code")


# Independent statement of the symbol grammar: one regular expression per form, anchors as joins.
cte("ckeys", "select distinct asset, root, raw_symbol, maturity_year, maturity_month from clean where kind='combo'")
cte("ctype", """select *, case when raw_symbol like 'UD:%' then 'user_defined' when raw_symbol not like '%:%' then 'plain' else coalesce(map {'BF':'butterfly','BB':'butterfly3','CF':'condor','DF':'condor4',
  'AB':'average','SB':'pack','C1':'crack'}[split_part(split_part(raw_symbol,':',2),' ',1)], 'labeled') end as combo_type from ckeys""")
L = "[FGHJKMNQUVXZ][0-9]{1,2}"
cte("ctok", f"""select *, case
  when combo_type='plain' and regexp_full_match(raw_symbol, '[A-Z0-9]+-[A-Z0-9]+') then string_split(raw_symbol,'-')
  when combo_type='labeled' and regexp_full_match(raw_symbol, '[^:]+:[A-Z0-9]+ [^-]+-[^-]+') then [split_part(raw_symbol,':',1)||split_part(split_part(raw_symbol,' ',2),'-',1), split_part(split_part(raw_symbol,':',2),' ',1)||split_part(split_part(raw_symbol,' ',2),'-',2)]
  when combo_type='crack' then [regexp_extract(raw_symbol, ':C1 ([A-Z0-9]+)', 1) || coalesce(nullif(regexp_extract(raw_symbol, ':C1 [A-Z0-9]+ ({L})-', 1),''), regexp_extract(raw_symbol, '({L})$', 1)), regexp_extract(raw_symbol, '-([A-Z0-9]+) ', 1) || regexp_extract(raw_symbol, '({L})$', 1)]
  when combo_type in ('butterfly','butterfly3') then string_split(split_part(raw_symbol,' ',2),'-')
  when combo_type in ('condor','condor4') then regexp_extract_all(split_part(raw_symbol,' ',2), '[FGHJKMNQUVXZ][0-9]')
  when combo_type='average' then [split_part(raw_symbol,' ',3)] when combo_type='pack' and root='SR3' then string_split(split_part(raw_symbol,' ',3),'-') end as toks from ctype""")
cte("cleg", f"""select k.*, t.pos, case when regexp_full_match(t.tok, '{L}') then root else regexp_extract(t.tok, '^([A-Z0-9]{{1,4}}){L}$', 1) end as leg_root,
  regexp_extract(t.tok, '({L})$', 1)[1] as code, regexp_extract(t.tok, '[FGHJKMNQUVXZ]([0-9]{{1,2}})$', 1) as digits from ctok k, (select unnest(range(1,5)) as pos) p, lateral (select p.pos as pos, k.toks[p.pos] as tok) t where t.tok is not null""")
cte("canchor", """select l.*, a.pos as apos, a.digits as ad from cleg l left join cleg a on a.asset=l.asset and a.raw_symbol=l.raw_symbol and a.maturity_year=l.maturity_year and a.maturity_month=l.maturity_month
  and a.code=substr('FGHJKMNQUVXZ', a.maturity_month, 1) and length(a.digits)=1""")
cte("cyear", """select *, case when length(digits)=2 then 2000+cast(digits as integer) when ad is not null then maturity_year+(cast(digits as integer)-cast(ad as integer)+10)%10 end as yr from canchor""")
cte("cpick", """select asset, raw_symbol, maturity_year, maturity_month, apos from (select *, row_number() over (partition by asset, raw_symbol, maturity_year, maturity_month order by span, apos) as k from (
  select asset, raw_symbol, maturity_year, maturity_month, apos, max(yr)-min(yr) as span from cyear group by all having count(yr)=count(*))) where k=1""")
cte("csym", """select y.asset, y.root, y.raw_symbol, y.maturity_year, y.maturity_month, y.combo_type, list(leg_root||code||lpad(cast(yr%100 as varchar),2,'0')||'.X' order by yr*12+position(code in 'FGHJKMNQUVXZ'), pos) as syms,
  bool_or(leg_root not like 'N%' and leg_root<>'SR3') as unknown from cyear y join cpick p on y.asset=p.asset and y.raw_symbol=p.raw_symbol and y.maturity_year=p.maturity_year and y.maturity_month=p.maturity_month and y.apos is not distinct from p.apos group by 1,2,3,4,5,6""")
cte("ckey", """select t.asset, t.raw_symbol, t.maturity_year, t.maturity_month, t.combo_type, case when t.combo_type='user_defined' then 'user_defined' when t.toks is null then case when t.combo_type in ('plain','labeled','crack') then 'not_2_legs' else 'leg_parse_fail' end
  when s.syms is null then 'leg_parse_fail' when s.unknown then 'unknown_root' end as reject_reason, s.syms from ctok t left join csym s on t.asset=s.asset and t.raw_symbol=s.raw_symbol and t.maturity_year=s.maturity_year and t.maturity_month=s.maturity_month""")


def roots(spark, d):
    """Tracked products: one root per nation plus the pack root."""
    n = dv.table(spark, d, "nation").select(F.concat(F.lit("N"), F.element_at(F.split("n_name", "_"), -1)).alias("leg_root"))
    return n.unionByName(n.select(F.lit("SR3").alias("leg_root")).distinct()).withColumn("leg_exchange", F.lit("X"))


@query("combo_classification", "R1", "select asset, raw_symbol, maturity_year, maturity_month, combo_type from ctype")
def _(spark, d):
    k = clean(spark, d).where("kind = 'combo'").select(*combos.KEYS).distinct()
    return k.select("asset", "raw_symbol", "maturity_year", "maturity_month", combos.classify(F.col("raw_symbol")).alias("combo_type"))


@query("combo_legs_resolved", "R2 R3 R4 R5 J3", """select asset, raw_symbol, maturity_year, maturity_month, reject_reason, case when reject_reason is null then array_to_string(syms, ' / ') end as legs from ckey""")
def _(spark, d):
    k = combos.resolve_keys(clean(spark, d).where("kind = 'combo'").select(*combos.KEYS), roots(spark, d))
    return k.select("asset", "raw_symbol", "maturity_year", "maturity_month", "reject_reason",
                    F.concat_ws(" / ", "out.contract_symbol").alias("l")).select(
        "asset", "raw_symbol", "maturity_year", "maturity_month", "reject_reason", F.when(F.col("reject_reason").isNull(), F.col("l")).alias("legs"))


# The tables hold the combos of every venue; the counters and the transform count those of the excluded venue instead.
CROWS = """from clean c join ckey k on c.asset=k.asset and c.raw_symbol=k.raw_symbol and c.maturity_year=k.maturity_year and c.maturity_month=k.maturity_month where c.kind='combo'"""


def combo_rows(spark, d, excluded=None):
    """Keys come from the definitions, so the raw rows are read once and nothing is written between."""
    keys = definitions(spark, d).where("instrument_class = 'S'")
    return combos.resolve_rows(clean(spark, d).where("kind = 'combo'"), roots(spark, d), excluded, keys)


@query("combo_reject_row_counts", "R6", f"""select c.asset, reject_reason, count(*) as row_count {CROWS} and c.asset not in ('N5','N10') and reject_reason is not null group by c.asset, reject_reason
 union all select asset, 'venue_unsupported', count(*) from clean where kind='combo' and asset in ('N5','N10') group by asset""")
def _(spark, d):
    return combos.reject_counts(combo_rows(spark, d, ice()))


@query("combo_spread_table", "R6", f"""select date, round(close,2) as close, volume, c.asset, c.raw_symbol as spread_symbol, syms[1] as near_contract_symbol, syms[2] as far_contract_symbol {CROWS} and reject_reason is null and combo_type in ('plain','labeled','crack')""")
def _(spark, d):
    return rounded(combos.bucket_table(combo_rows(spark, d), "spread").select("date", "close", "volume", "asset", "spread_symbol", "near_contract_symbol", "far_contract_symbol"), 2)


@query("combo_butterfly_table", "R6", f"""select date, round(close,2) as close, c.asset, c.raw_symbol as butterfly_symbol, syms[1] as near_contract_symbol, syms[2] as mid_contract_symbol, syms[3] as far_contract_symbol {CROWS} and reject_reason is null and combo_type in ('butterfly','butterfly3')""")
def _(spark, d):
    return rounded(combos.bucket_table(combo_rows(spark, d), "butterfly").select("date", "close", "asset", "butterfly_symbol", "near_contract_symbol", "mid_contract_symbol", "far_contract_symbol"), 2)


@query("combo_condor_table", "R6", f"""select date, round(close,2) as close, c.asset, c.raw_symbol as condor_symbol, syms[1] as near_contract_symbol, syms[2] as mid1_contract_symbol, syms[3] as mid2_contract_symbol, syms[4] as far_contract_symbol {CROWS} and reject_reason is null and combo_type in ('condor','condor4')""")
def _(spark, d):
    return rounded(combos.bucket_table(combo_rows(spark, d), "condor").select("date", "close", "asset", "condor_symbol", "near_contract_symbol", "mid1_contract_symbol", "mid2_contract_symbol", "far_contract_symbol"), 2)


@query("combo_average_and_pack_tables", "R6", f"""select 'average' as bucket, date, round(close,2) as close, c.asset, c.raw_symbol as symbol, cast(replace(split_part(c.raw_symbol,' ',2),'Y','') as integer) as avg_years, syms[1] as first_symbol, null as last_symbol {CROWS} and reject_reason is null and combo_type='average'
 union all select 'pack', date, round(close,2), c.asset, c.raw_symbol, null, syms[1], syms[2] {CROWS} and reject_reason is null and combo_type='pack'""")
def _(spark, d):
    r = combo_rows(spark, d)
    a = combos.bucket_table(r, "average").select(F.lit("average").alias("bucket"), "date", "close", "asset", F.col("average_symbol").alias("symbol"), "avg_years",
                                                 F.col("anchor_contract_symbol").alias("first_symbol"), F.lit(None).cast("string").alias("last_symbol"))
    p = combos.bucket_table(r, "pack").select(F.lit("pack").alias("bucket"), "date", "close", "asset", F.col("pack_symbol").alias("symbol"), F.lit(None).cast("int").alias("avg_years"),
                                              F.col("near_contract_symbol").alias("first_symbol"), F.col("far_contract_symbol").alias("last_symbol"))
    return rounded(a.unionByName(p), 2)


# The whole transform: bars know their product, so one without definition keeps its asset.
cte("product", "select p_partkey, case when p_partkey%16=11 and p_size%2=0 then 'SR3' else 'N' || cast(p_partkey%25 as varchar) end as asset from part")
cte("tr_rows", """select r.*, coalesce(drop_at, case when r.asset in ('N5','N10') then 'venue_unsupported' else k.reject_reason end, case when k.combo_type in ('plain','labeled','crack') then 'spread' when k.combo_type like 'butterfly%' then 'butterfly' when k.combo_type like 'condor%' then 'condor' else k.combo_type end) as target
 from (select *, case when raw_symbol is null then 'unmatched' when 9223372036854775807 in (open,high,low,close) then 'sentinel' when instrument_class='X' then 'other_class' when instrument_class='F' then
   case when asset in ('N5','N10') and raw_symbol like '%\\_Z' escape '\\' then 'z_variant' when 0 in (open,high,low,close) then 'incomplete_price' else 'outright' end end as drop_at
  from (select b.date, b.instrument_id, b.open, b.high, b.low, b.close, b.volume, p.asset, b.instrument_class, b.raw_symbol, b.maturity_year as my, b.maturity_month as mm from defined b join product p on p.p_partkey=b.instrument_id)) r
 left join ckey k on k.asset=r.asset and k.raw_symbol=r.raw_symbol and k.maturity_year=r.my and k.maturity_month=r.mm and r.instrument_class='S'""")
REMARK_SQL = ", ".join(f"case when count(*) filter (where target='{t}')>0 then '{r}=' || count(*) filter (where target='{t}') end" for r, t in combos.REMARKS.items())
BAD = "target='outright' and (open<=0 or high<=0 or low<=0 or close<=0)"
VIOLATES = "target='outright' and (high<low or high<open or high<close or low>open or low>close)"


def transformed(spark, d):
    """(tables, observed counters) over every product."""
    p = dv.table(spark, d, "part").select(F.col("p_partkey").alias("instrument_id"), "p_size")
    i = F.col("instrument_id")
    p = p.select("instrument_id", F.when((i % 16 == 11) & (F.col("p_size") % 2 == 0), "SR3").otherwise(F.concat(F.lit("N"), (i % 25).cast("string"))).alias("asset"))
    bars = raw_bars(spark, d).join(p, "instrument_id").withColumn("root", F.col("asset")).withColumn("exchange", F.lit("X"))
    more = spark.createDataFrame([("N99", "X")], "leg_root string, leg_exchange string")  # a product without raw rows
    return combos.transform(bars, definitions(spark, d), roots(spark, d).unionByName(more), ice(), one_a_day=True)


@query("transform_manifest", "S17 R7", f"""select *, case when status_odd then 'PARTIAL' else 'OK' end as status from (
 select asset, count(*) as rows_read, {', '.join(f"count(*) filter (where target='{t}') as {c}" for c, t in combos.COUNTERS.items())},
  count(*) filter (where {BAD}) as non_positive_price_rows, count(*) filter (where target='outright' and volume=0) as zero_volume_outright_rows, count(*) filter (where {VIOLATES}) as ohlc_violation_rows,
  nullif(concat_ws('; ', {REMARK_SQL}), '') as detail, count(*) filter (where target not in ('outright','spread','butterfly','condor','average','pack','other_class') or {BAD} or {VIOLATES})>0 as status_odd from tr_rows group by asset
 union all select 'N99', {', '.join('0' for _ in range(4 + len(combos.COUNTERS)))}, null, null)""".replace("select *, case when status_odd then", "select * exclude (status_odd), case when status_odd is null then 'NO_RAW_DATA' when status_odd then"))
def _(spark, d):
    return transformed(spark, d)[0]["manifest"]


@query("transform_all_tables", "R7 S17", """select case target when 'outright' then 'term_structure' else target end as target, count(*) as row_count, count(*) as observed from tr_rows where target in ('outright','spread','butterfly','condor','average','pack') group by 1""")
def _(spark, d):
    """Rows of each table as read back, beside those observed while the transform was written."""
    tables, seen = transformed(spark, d)
    out = None
    for n, x in tables.items():
        if n not in ("rejects", "manifest"):
            c = x.groupBy(F.lit(n).alias("target")).agg(F.count(F.lit(1)).alias("row_count"))
            c = c.withColumn("observed", F.lit(seen["outright" if n == "term_structure" else n]).cast("long"))
            out = c if out is None else out.unionByName(c)
    return out
