"""Reversal, carry, cross-sectional momentum, value and seasonality."""
from pyspark.sql import functions as F

from termflow.functions.cols import rounded
from termflow.operators import xs
from termflow.operators.signals import cross_section as op
from termflow.operators.signals.trend import tsmom
from termflow.plans.q_curve import carry_w
from termflow.plans.q_xs import arank
from termflow.plans.registry import cte, query
from termflow.sources import driver_views as dv, market as mk

cte("lag_w", """select asset, sector, date, l, (close/lag(close, l) over (partition by asset, l order by date)-1) as r,
  (close/lag(close, l) over (partition by asset, l order by date)-1)/nullif(vol,0) as z from vol_w cross join (values (1),(2),(3)) t(l)""")


@query("lag_returns_standardized", "G11", "select asset, date, l, round(r,6) as r, round(z,6) as z from lag_w")
def _(spark, d):
    lags = [F.struct(F.lit(n).alias("l"), op.lag_return("close", n).alias("r"), op.standardized_return("close", "vol", n).alias("z")) for n in (1, 2, 3)]
    return rounded(mk.vol_w(spark, d).select("asset", "date", F.array(*lags).alias("x")).select("asset", "date", F.inline("x")))


@query("individual_reversal", "G12", """select asset, date, case when count(z) over s>=2 then round(-(z-avg(z) over s),6) end as signal from lag_w where l=1 window s as (partition by date, sector)""")
def _(spark, d):
    return rounded(op.individual_reversal(mk.vol_w(spark, d), 1).select("asset", "date", "signal"))


cte("srev_w", "select l, sector, date, -(z-avg(z) over (partition by l, date)) as s from (select l, sector, date, avg(z) as z from lag_w group by all)")


@query("sector_reversal", "G13", "select asset, p.date, round(s,6) as signal from panel_w p join srev_w r on p.date=r.date and p.sector=r.sector where l=1")
def _(spark, d):
    return rounded(op.sector_reversal(mk.vol_w(spark, d), 1).select("asset", "date", "signal"))


@query("all_reversal_specs", "G14", """select asset, date, 'individual_' || l || 'd' as spec, case when count(z) over s>=2 then round(-(z-avg(z) over s),6) end as signal from lag_w window s as (partition by l, date, sector)
 union all select asset, p.date, 'sector_' || l || 'd', round(s,6) from panel_w p join srev_w r on p.date=r.date and p.sector=r.sector""")
def _(spark, d):
    return rounded(op.all_reversals(mk.vol_w(spark, d)))


cte("carry_m", """select asset, last_day(date) as label, max(date) as date, year(date)*12+month(date) as mi, arg_max(carry, date) filter (where carry is not null) as v from carry_w group by all""")
cte("carry_s", """select p.asset, p.sector, p.date, p.carry, last_value(m.v ignore nulls) over (partition by p.asset order by p.date) as smoothed from carry_w p left join
  (select a.asset, a.date, avg(b.v) as v from carry_m a join carry_m b on a.asset=b.asset and b.mi between a.mi-2 and a.mi group by a.asset, a.date having count(b.v)=3) m on p.asset=m.asset and p.date=m.date""")


def srank(x):
    return f"case when count({x}) over (partition by date, sector)>=2 then {arank(x, 'date, sector')}-(count({x}) over (partition by date, sector)+1)/2.0 end"


cte("carry_ref", "select sector, date, avg(c) over (partition by sector order by date) as ref from (select sector, date, avg(carry) as c from carry_w group by sector, date)")


@query("carry_signal_specs", "G15 G16 G17", f"""select s.asset, s.date, {srank('carry')} as carry1m, {srank('smoothed')} as carry1_12,
 case when carry>0 then 1.0 else -1.0 end::double as timing_zero, case when carry-ref>0 then 1.0 else -1.0 end::double as timing_mean
 from (select c.*, ref from carry_s c join carry_ref r on c.date=r.date and c.sector=r.sector) s""")
def _(spark, d):
    return op.carry_specs(carry_w(spark, d), n_months=3, align="last_trading_day")


@query("carry_smoothed", "G16", "select asset, date, round(smoothed,6) as smoothed from carry_s")
def _(spark, d):
    return rounded(op.carry_smoothed(carry_w(spark, d), "carry", 3, "last_trading_day").select("asset", "date", "smoothed"))


cte("month_w", "select asset, sector, last_day(date) as label, max(date) as last_date, year(date)*12+month(date) as mi, arg_max(close, date) filter (where close is not null) as v from panel_w group by all")
cte("xsm_w", """select p.asset, p.sector, p.date, last_value(m.x ignore nulls) over (partition by p.asset order by p.date) as raw from panel_w p left join
 (select a.asset, a.label, b.v/c.v-1 as x from month_w a left join month_w b on a.asset=b.asset and b.mi=a.mi-1 left join month_w c on a.asset=c.asset and c.mi=a.mi-13) m
 on p.asset=m.asset and p.date=m.label""")


@query("skip_month_momentum", "G18", "select asset, date, round(raw,6) as raw from xsm_w")
def _(spark, d):
    return rounded(op.skip_month_momentum(mk.panel_w(spark, d)).select("asset", "date", "raw"))


@query("cross_sectional_momentum", "G19", f"select asset, date, {srank('raw')} as signal from xsm_w")
def _(spark, d):
    return op.skip_month_momentum(mk.panel_w(spark, d)).select("asset", "date", xs.sector_rank("raw").alias("signal"))


def value_sql(end, win, at):
    return f"""select p.asset, p.sector, p.date, last_value(m.x ignore nulls) over (partition by p.asset order by p.date) as raw from panel_w p left join
 (select a.asset, a.label, a.last_date, ln(avg(b.v)/a.v) as x from month_w a join month_w b on a.asset=b.asset and b.mi between a.mi-{end + win - 1} and a.mi-{end} group by a.asset, a.label, a.last_date, a.v
  having count(b.v)={win}) m on p.asset=m.asset and p.date=m.{at}"""


cte("val_w", value_sql(24, 6, "last_date"))


@query("long_run_value_default", "G20", f"select asset, date, round(raw,6) as raw from ({value_sql(54, 12, 'label')})")
def _(spark, d):
    return rounded(op.long_run_value(mk.panel_w(spark, d)).select("asset", "date", "raw"))


@query("long_run_value", "G20", "select asset, date, round(raw,6) as raw from val_w")
def _(spark, d):
    return rounded(op.long_run_value(mk.panel_w(spark, d), end=24, window=6, align="last_trading_day").select("asset", "date", "raw"))


# Yields and prices by series: the order-value series stand in, one mapped asset per series.
cte("macro", """select o_orderpriority as series, cast(o_orderdate as date) as date, sum(cast(floor(o_totalprice*100+0.5) as bigint))/100.0::double as value from orders group by 1, 2""")
cte("macro_m", "select series, year(date)*12+month(date) as mi, arg_max(value, date) as v, max(date) as md from macro group by 1, 2")
cte("cal_m", "select last_day(date) as label, max(date) as last_date, year(date)*12+month(date) as mi from panel_w group by 1, 3")
MAP = "(values ('NATION_0','1-URGENT'),('NATION_7','2-HIGH'),('NATION_18','5-LOW')) mp(asset, series)"
FXMAP = "(values ('NATION_4','3-MEDIUM'),('NATION_9','4-NOT SPECIFIED')) mp(asset, series)"
cte("bond_w", f"""select p.asset, p.sector, p.date, last_value(c.x ignore nulls) over (partition by p.asset order by p.date) as raw from panel_w p join {MAP} on p.asset=mp.asset left join
 (select a.series, a.v-b.v as x, a.md from macro_m a left join macro_m b on a.series=b.series and b.mi=a.mi-12) c on c.series=mp.series and p.date=c.md""")
cte("fx_w", f"""select asset, sector, date, last_value(x ignore nulls) over (partition by asset order by date rows between 35 preceding and current row) as raw from (
 select p.asset, p.sector, p.date, n.x from panel_w p join {FXMAP} on p.asset=mp.asset left join (select a.asset, a.last_date, a.x-(f.i-h.i) as x from
  (select a.asset, a.last_date, a.mi, ln(avg(b.v)/a.v) as x from month_w a join month_w b on a.asset=b.asset and b.mi between a.mi-29 and a.mi-24 group by a.asset, a.last_date, a.mi, a.v having count(b.v)=6) a
  join {FXMAP} on mp.asset=a.asset left join (select x.series, x.mi, ln(x.v/y.v) as i from macro_m x left join macro_m y on x.series=y.series and y.mi=x.mi-12) f on f.series=mp.series and f.mi=a.mi
  left join (select x.mi, ln(x.v/y.v) as i from macro_m x left join macro_m y on x.series=y.series and y.mi=x.mi-12 where x.series='1-URGENT') h on h.mi=a.mi) n on n.asset=p.asset and n.last_date=p.date)""")
cte("valp_w", """select v.asset, v.sector, v.date, case when f.asset is not null then f.raw when b.asset is not null then b.raw else v.raw end as raw from val_w v
 left join bond_w b on v.asset=b.asset and v.date=b.date left join fx_w f on v.asset=f.asset and v.date=f.date""")


def series_map(spark, d, m):
    """(asset, series) rows for a short mapping, read off the nation table."""
    pick = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return dv.table(spark, d, "nation").select(F.col("n_name").alias("asset")).withColumn("series", pick[F.col("asset")]).where("series is not null")


BOND = {"NATION_0": "1-URGENT", "NATION_7": "2-HIGH", "NATION_18": "5-LOW"}
FX = {"NATION_4": "3-MEDIUM", "NATION_9": "4-NOT SPECIFIED"}


def macro_long(spark, d):
    return dv.macro(spark, d).withColumnRenamed("ref_date", "date")


def bond_value(spark, d, p):
    return op.yield_change_value(p, macro_long(spark, d), series_map(spark, d, BOND), 12, "last_trading_day")


def fx_value(spark, d, p):
    return op.relative_price_value(p, macro_long(spark, d), series_map(spark, d, FX), "1-URGENT", end=24, window=6, lag=12, align="last_trading_day")


def value_all(spark, d):
    p = mk.panel_w(spark, d)
    return op.value_panel(op.long_run_value(p, end=24, window=6, align="last_trading_day"), bond_value(spark, d, p), fx_value(spark, d, p))


@query("bond_yield_change_value", "G21", "select asset, date, round(raw,4) as raw from bond_w")
def _(spark, d):
    return rounded(bond_value(spark, d, mk.panel_w(spark, d)).select("asset", "date", "raw"), 4)


@query("currency_relative_price_value", "G22", "select asset, date, round(raw,6) as raw from fx_w")
def _(spark, d):
    return rounded(fx_value(spark, d, mk.panel_w(spark, d)).select("asset", "date", "raw"))


@query("value_signal", "G23", f"select asset, date, {srank('raw')} as signal from valp_w")
def _(spark, d):
    return value_all(spark, d).select("asset", "date", xs.sector_rank("raw").alias("signal"))


@query("half_month_signal", "G24", "select asset, date, round(0.4*case when day(date)<=15 then 1 else -1 end/nullif(vol,0),6) as signal from vol_w where close is not null union all select asset, date, null from vol_w where close is null")
def _(spark, d):
    return rounded(op.half_month(mk.vol_w(spark, d)).select("asset", "date", "signal"))


cte("same_w", """select asset, label, last_date, mi, case when count(r) over w>=2 then avg(r) over w end as score from (
  select a.asset, a.label, a.last_date, a.mi, a.v/b.v-1 as r from month_w a left join month_w b on a.asset=b.asset and b.mi=a.mi-1)
  window w as (partition by asset, month(label) order by mi rows between 4 preceding and 1 preceding)""")
cte("samesig_w", """select p.asset, p.sector, p.date, last_value(m.x ignore nulls) over (partition by p.asset order by p.date) as raw from panel_w p left join
  (select a.asset, a.last_date, b.score as x from same_w a left join same_w b on a.asset=b.asset and b.mi=a.mi+1) m on p.asset=m.asset and p.date=m.last_date""")


@query("same_month_average_return", "G25", "select asset, label, round(score,6) as score from same_w")
def _(spark, d):
    from termflow.operators.signals.monthly import month_ends, month_lag
    from termflow.functions.cols import div
    per = month_ends(mk.panel_w(spark, d), "close").withColumn("r", div("close", month_lag("close", 1)) - 1)
    return rounded(op.same_month_mean(per, "r", 2, 4).select("asset", "label", "score"))


@query("same_month_signal", "G26", f"select asset, date, {srank('raw')} as signal from samesig_w")
def _(spark, d):
    return op.same_month_raw(mk.panel_w(spark, d), min_years=2, max_years=4, align="last_trading_day").select(
        "asset", "date", xs.sector_rank("raw").alias("signal"))


WINDOWS = {"NATION_1": (11, 3), "NATION_2": (6, 8), "NATION_3": (3, 6)}
# November-March: day 305 to 90, 151 days, center 15.5 after the wrap; June-August: 152..243; March-June: 60..181.
cte("season_w", """select p.*, case when c is null then 1.0 else 1.0+0.5*(case when least(abs(dy-c), 365-abs(dy-c))<=h then 0.5*(1+cos(pi()*least(abs(dy-c), 365-abs(dy-c))/h)) else 0 end) end as weight
 from (select asset, date, signal, least(dayofyear(date),365)::double as dy from sig_w) p left join (values ('NATION_1', 15.5, 75.5), ('NATION_2', 198.0, 46.0), ('NATION_3', 121.0, 61.0)) s(asset, c, h) on p.asset=s.asset""")


@query("seasonal_weight", "G27", "select asset, date, round(weight,6) as weight from season_w")
def _(spark, d):
    return rounded(op.seasonal_weight(mk.panel_w(spark, d).select("asset", "date"), WINDOWS))


@query("seasonal_scaled_momentum", "G28", "select asset, date, round(signal*weight,6) as signal from season_w")
def _(spark, d):
    x = op.seasonal_weight(tsmom(mk.vol_w(spark, d), lookback_months=12, per_month=1), WINDOWS)
    return rounded(x.select("asset", "date", (F.col("signal") * F.col("weight")).alias("signal")))
