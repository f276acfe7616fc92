"""Streaming replays of the driver tables."""
from pyspark.sql import functions as F

from termflow.functions.cols import rounded
from termflow.plans.registry import query
from termflow.session import materialize, scratch_path
from termflow.sources import driver_views as dv, market as mk
from termflow.streaming import ingest as st, recursions as rc


def time_slices(df, parts, order):
    """The table as consecutive time slices."""
    t = F.col(order).cast("timestamp").cast("double")
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    width = (hi - lo) / parts
    return [df.where((t >= lo + i * width) & (F.lit(True) if i == parts - 1 else t < lo + (i + 1) * width)) for i in range(parts)]


def event_slices(spark, d):
    # One closing row far ahead moves the watermark past the last real day.
    e = dv.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    end = e.agg(F.max("event_id").alias("event_id"), (F.max("ts") + F.expr("interval 5 days")).alias("ts"), F.max("user_id").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    return time_slices(e.unionByName(end), 4, "ts")


BARS = """select cast(ts as date) as date, event_type, arg_min(value, event_id) as open, max(value) as high, min(value) as low, arg_max(value, event_id) as close, count(*) as n from events group by 1, 2"""


@query("streaming_daily_bars", "W2", BARS)
def _(spark, d):
    with st.state_layout(spark):
        out = st.run_slices(event_slices(spark, d), st.daily_bars, spark, name="bars")
    return spark.read.parquet(out).where("event_type <> 'end'")


@query("streaming_upsert_ingest", "W1", "select user_id, event_type, cast(max(ts) as date) as last_date, arg_max(value, ts) as value from events group by 1, 2")
def _(spark, d):
    sink = st.UpsertSink(scratch_path(spark, "upsert-stream"), ["user_id", "event_type"], "ts", compact_every=2, buckets=4)
    st.run_slices(event_slices(spark, d), lambda e: e.where("event_type <> 'end'"), spark, sink, "upsert")
    return sink.table(spark).select("user_id", "event_type", F.to_date("ts").alias("last_date"), "value")


@query("streaming_dimension_enrichment", "W4", "select n_name as asset, event_type, count(*) as n, round(sum(value),4) as total from events left join nation on user_id%25=n_nationkey group by 1, 2")
def _(spark, d):
    dim = dv.table(spark, d, "nation").select((F.col("n_nationkey").cast("long")).alias("k"), F.col("n_name").alias("asset"))
    make = lambda e: st.enrich(e.where("event_type <> 'end'").withColumn("k", F.col("user_id") % 25), dim, "k").select("asset", "event_type", "value")
    out = st.run_slices(event_slices(spark, d), make, spark, name="enrich")
    return rounded(spark.read.parquet(out).groupBy("asset", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


def disordered_slices(df, parts, key, order="date"):
    """Time slices of which a third of the rows arrive one slice late, and the delay that still takes them in.

    One row far ahead moves the watermark past the last real day; its own key is never folded.
    """
    t = F.unix_date(order)
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    width = -(-(hi - lo + 1) // parts)
    late = (F.pmod(F.xxhash64(key, order), F.lit(3)) == 0).cast("int")
    x = df.withColumn("__part", F.least(F.floor((t - lo) / width) + late, F.lit(parts)).cast("int"))
    end = df.agg(F.max(order).alias("d")).select(F.lit("~end").alias(key), F.date_add("d", 2 * width + 30).alias(order), *[F.lit(1.0).alias(c) for c in df.columns if c not in (key, order)])
    last = x.where(F.col("__part") == parts).drop("__part").unionByName(end)
    return [x.where(F.col("__part") == i).drop("__part") for i in range(parts)] + [last], f"{width + 1} days"


def folded(spark, df, key, make, name):
    """The recursion over the disordered slices; make(stream, delay)."""
    slices, delay = disordered_slices(df, 3, key)
    with st.state_layout(spark, rocks=True):
        out = st.run_slices(slices, lambda s: make(s, delay), spark, name=name)
    return spark.read.parquet(out).where(F.col(key) != "~end")


@query("streaming_ewma_volatility", "W3", "select n.asset, n.date, round(sqrt(e.avg*52),6) as ewma_vol from ewma_x e join ret_n n on n.asset=e.asset and n.t=e.t")
def _(spark, d):
    p = materialize(mk.panel_w(spark, d).select("asset", "date", "close"), "stream-panel")
    out = folded(spark, p, "asset", lambda s, delay: rc.ewma(s, 12, delay), "ewma")
    return rounded(out.select("asset", "date", F.sqrt(F.col("ewma_var") * 52).alias("ewma_vol")))


@query("streaming_kalman_hedge", "W3", "select n.pair, n.date, case when n.t>60 then round(x.a,4) end as alpha, case when n.t>60 then round(x.b,5) end as beta from kal_x x join kal_n n on n.pair=x.pair and n.t=x.t")
def _(spark, d):
    from termflow.plans.q_rv import pair_logs
    p = materialize(pair_logs(spark, d).select("pair", "date", "ly", "lx").where("ly is not null and lx is not null"), "stream-pairs")
    return rounded(folded(spark, p, "pair", lambda s, delay: rc.kalman(s, "ly", "lx", delay), "kalman"), 5, alpha=4)


@query("streaming_channel_state", "W3", "select n.asset, n.date, n.system, x.outv as state from don_x x join don_n n on n.asset=x.asset and n.system=x.system and n.t=x.t")
def _(spark, d):
    p = materialize(mk.panel_w(spark, d).select("asset", "date", "close"), "stream-panel")
    return folded(spark, p, "asset", lambda s, delay: rc.channel(s, [(8, 4), (13, 6)], delay), "channel")
