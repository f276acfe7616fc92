"""Shared SQL views over the driver tables, restated independently for the checking side."""
from termflow.plans.registry import cte

cte("sup", """select s_suppkey, n_name as asset, r_name as sector from supplier
  join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey""")
cte("li", """select asset, sector, cast(l_shipdate as date) as date, l_orderkey, l_linenumber, l_quantity,
  cast(floor(l_extendedprice*100+0.5) as bigint) as px from lineitem join sup on l_suppkey=s_suppkey""")
cte("bars_d", """select asset, sector, date,
  cast(arg_min(px, cast(l_orderkey as hugeint)*10000000000000000::hugeint+px) as double)/100 as open,
  max(px)/100.0::double as high, min(px)/100.0::double as low,
  cast(sum(px) as double)/100.0::double/count(*) as close, sum(l_quantity) as volume, count(*) as n,
  cast(sum(px) as bigint) as cents from li group by asset, sector, date""")
cte("bars_w", """select asset, sector, date + cast((12-dayofweek(date))%7 as integer) as date,
  arg_min(open, date) as open, max(high) as high, min(low) as low,
  cast(sum(cents) as double)/100.0::double/cast(sum(n) as bigint) as close, sum(volume) as volume
  from bars_d group by asset, sector, 3""")
cte("panel_w", """select a.asset, a.sector, c.date, b.open, b.high, b.low, b.close, b.volume
  from (select distinct asset, sector from bars_w) a cross join (select distinct date from bars_w) c
  left join bars_w b on a.asset=b.asset and c.date=b.date""")
cte("panel_d", """select a.asset, a.sector, c.date, b.open, b.high, b.low, b.close, b.volume
  from (select distinct asset, sector from bars_d) a cross join (select distinct date from bars_d) c
  left join bars_d b on a.asset=b.asset and c.date=b.date""")
cte("ret_w", """select *, close/lag(close) over (partition by asset order by date)-1 as ret from panel_w""")
cte("vol_w", """select *, case when count(ret) over w >= 13 then stddev_samp(ret) over w * sqrt(52) end as vol
  from ret_w window w as (partition by asset order by date rows between 25 preceding and current row)""")
cte("mom_w", """select *, close/nullif(lag(close,12) over (partition by asset order by date),0)-1 as mom from vol_w""")
cte("sig_w", """select asset, sector, date, ret, vol, mom, close, volume, 0.4*sign(mom)/nullif(vol,0) as signal from mom_w""")
cte("pos_w", """select asset, sector, date, ret, volume, coalesce(p/nullif(sum(abs(p)) over (partition by date),0),0) as pos
  from (select *, lag(signal) over (partition by asset order by date) as p from sig_w)""")
cte("pnl_w", """select date, coalesce(sum(pos*ret),0) as pnl from pos_w group by date""")
