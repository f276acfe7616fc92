"""Bars, dense panels, returns, resampling."""
from pyspark.sql import functions as F

from termflow.functions.cols import ffill, rounded
from termflow.operators import panel as op
from termflow.plans.registry import query
from termflow.sources import driver_views as dv, market as mk


@query("bars_daily", "W2", "select asset, sector, date, open, high, low, close, volume from bars_d")
def _(spark, d):
    return dv.bars_d(spark, d).drop("n", "cents")


@query("bars_weekly", "S3", "select * from bars_w")
def _(spark, d):
    return dv.bars_w(spark, d)


@query("panel_densify_daily", "S1", "select * from panel_d")
def _(spark, d):
    return mk.panel_d(spark, d)


ASSETS = [f"NATION_{i}" for i in range(25)]


@query("panel_pivot_close", "S6", "select date, " + ", ".join(f"""max(close) filter (where asset='{a}') as "{a}" """ for a in ASSETS) + " from panel_d group by date")
def _(spark, d):
    return op.pivot_field(mk.panel_d(spark, d), "close", ASSETS)


@query("gap_safe_return_daily", "V1", """
select asset, date, round(close/lag(close) over (partition by asset order by date)-1, 6) as ret from panel_d""")
def _(spark, d):
    return rounded(mk.panel_d(spark, d).select("asset", "date", op.simple_return("close").alias("ret")))


@query("bounded_forward_fill", "S9", """
select asset, date, last_value(close ignore nulls) over (partition by asset order by date rows between 2 preceding and current row) as close
from panel_d""")
def _(spark, d):
    return mk.panel_d(spark, d).select("asset", "date", ffill("close", limit=2).alias("close"))


RESAMPLE_SQL = """
with m as (select asset, {lab} as label, max(date) as last_date, arg_max(close, date) filter (where close is not null) as v
  from {panel} group by asset, 2)
select p.asset, p.date, last_value(m.v ignore nulls) over (partition by p.asset order by p.date) as held
from {panel} p left join m on p.asset=m.asset and p.date=m.{at}"""


@query("weekly_positions_daily_panel", "B1", RESAMPLE_SQL.format(
    lab="date + cast((12-dayofweek(date))%7 as integer)", panel="panel_d", at="label"))
def _(spark, d):
    return op.resample_ffill(mk.panel_d(spark, d), "close", "weekly", out="held").select("asset", "date", "held")


@query("month_end_label_positions", "B2", RESAMPLE_SQL.format(lab="last_day(date)", panel="panel_w", at="label"))
def _(spark, d):
    return op.resample_ffill(mk.panel_w(spark, d), "close", "monthly", out="held").select("asset", "date", "held")


@query("month_end_last_day_positions", "P1 B2", RESAMPLE_SQL.format(lab="last_day(date)", panel="panel_w", at="last_date"))
def _(spark, d):
    return op.resample_ffill(mk.panel_w(spark, d), "close", "monthly", align="last_trading_day", out="held").select("asset", "date", "held")


@query("period_end_dates", "P1", """
select 'monthly' as freq, last_day(date) as label, max(date) as date from bars_w group by 2
union all select 'weekly', date + cast((12-dayofweek(date))%7 as integer), max(date) from bars_w group by 2""")
def _(spark, d):
    from termflow.functions.calendar import period_label
    dates = dv.bars_w(spark, d).select("date").distinct()
    both = [dates.groupBy(F.lit(f).alias("freq"), period_label("date", f).alias("label")).agg(F.max("date").alias("date"))
            for f in ("monthly", "weekly")]
    return both[0].unionByName(both[1])
