"""Market-data views derived from the order tables: bars, contracts, macro series, regimes.

Asset = supplier nation, sector = region, price = extended price. Prices are summed as whole
cents, so every bar is exact whatever the order in which rows arrive.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from termflow.functions.calendar import code_month, month_code, week_end

# An order key and a price in cents packed in one decimal, so "first price of the day" is a plain minimum in a
# hash aggregate. Every long key fits, and prices up to 10^15 cents either way of zero; a larger one fails the cast.
SPAN = "1000000000000000"
FIRST = f"cast(l_orderkey as decimal(19,0)) * {SPAN}0BD + cast(px + {SPAN} as decimal(16,0))"


# Declared layouts of the driver tables: no footer-inference job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


def cents(x: str) -> Column:
    return F.floor(F.col(x) * 100 + F.lit(0.5))


def assets(spark: SparkSession, d: str) -> DataFrame:
    """(suppkey, asset, sector)."""
    return (
        table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("n_name").alias("asset"), F.col("r_name").alias("sector"))
    )


def _cells() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.sum("px").alias("cents"),
        F.max("px").alias("hi"), F.min("px").alias("lo"),
        F.min(F.expr(FIRST)).alias("first_key"),
        F.sum("l_quantity").alias("volume"),
    ]


def _lines(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """Priced lines keyed by the supplier's nation number."""
    li = table(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_quantity", *extra, F.to_date("l_shipdate").alias("date"), cents("l_extendedprice").alias("px"))
    sup = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))


def _named(spark: SparkSession, d: str, cells: DataFrame) -> DataFrame:
    """Asset and sector names, attached to cells rather than to lines."""
    return cells.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnsRenamed({"n_name": "asset", "r_name": "sector"})


def _bar_cols() -> list[Column]:
    return [
        ((F.expr(f"cast(pmod(first_key, {SPAN}0BD) as long)") - int(SPAN)) / F.lit(100.0)).alias("open"),
        (F.col("hi") / F.lit(100.0)).alias("high"), (F.col("lo") / F.lit(100.0)).alias("low"),
        (F.col("cents") / F.lit(100.0) / F.col("n")).alias("close"), F.col("volume"),
    ]


def bars_d(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars. The supplier dimension is broadcast while the planner measures it small, else it is a
    sort-merge join whose hot suppliers adaptive execution splits; rows then collapse map-side to one
    cell per (asset, day) before the only full shuffle."""
    cells = _lines(spark, d).groupBy("s_nationkey", "date").agg(*_cells())
    return _named(spark, d, cells).select("asset", "sector", "date", *_bar_cols(), "n", "cents")


def bars_w(spark: SparkSession, d: str) -> DataFrame:
    """Weekly bars labelled by the Friday that ends the week."""
    b = bars_d(spark, d).withColumn("week", week_end("date"))
    return (
        b.groupBy("asset", "sector", "week").agg(
            F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            (F.sum("cents") / F.lit(100.0) / F.sum("n")).alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("week", "date")
    )


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Per-contract daily bars: delivery month = ship month + line number."""
    cells = _lines(spark, d, "l_linenumber").groupBy("s_nationkey", "date", "l_linenumber").agg(*_cells())
    c = _named(spark, d, cells).withColumn("expiry", F.add_months(F.trunc("date", "MM"), F.col("l_linenumber")))
    code = month_code(F.month("expiry"))
    return c.select(
        "asset", "sector", "date",
        F.concat(root_of("asset"), code,
                 F.lpad((F.year("expiry") % 100).cast("string"), 2, "0")).alias("contract_symbol"),
        root_of("asset").alias("root"),
        F.year("expiry").alias("expiry_year"), code.alias("expiry_code"), *_bar_cols())


def root_of(asset: str) -> Column:
    """NATION_12 -> N12."""
    return F.concat(F.substring(asset, 1, 1), F.element_at(F.split(asset, "_"), -1))


def spreads(c: DataFrame) -> DataFrame:
    """Quoted calendar spreads between the legs priced on a day: each leg against the next two.

    The quote is the difference of closes plus a volume-driven offset, so quotes and
    back-differenced values disagree; odd near volumes are re-rooted as cross-product quotes.
    """
    c = c.withColumn("m", F.col("expiry_year") * 12 + code_month("expiry_code"))
    w = W.partitionBy("asset", "date").orderBy("m")
    leg = F.struct("root", "contract_symbol", "expiry_year", "expiry_code", "close", "volume")
    c = c.withColumn("f1", F.lead(leg, 1).over(w)).withColumn("f2", F.lead(leg, 2).over(w))
    far = c.withColumn("far", F.explode(F.array("f1", "f2"))).where("far is not null")
    return far.select(
        "asset", "date", F.concat_ws("-", "contract_symbol", "far.contract_symbol").alias("spread_symbol"),
        F.col("root").alias("near_root"), F.col("contract_symbol").alias("near_contract_symbol"),
        F.col("expiry_year").alias("near_expiry_year"), F.col("expiry_code").alias("near_expiry_code"),
        F.when(F.col("volume") % 7 == 3, "ZZ").otherwise(F.col("far.root")).alias("far_root"),
        F.col("far.contract_symbol").alias("far_contract_symbol"), F.col("far.expiry_year").alias("far_expiry_year"),
        F.col("far.expiry_code").alias("far_expiry_code"),
        (F.col("close") - F.col("far.close") + (F.col("volume") - F.col("far.volume")) / 4).alias("close"),
        (F.col("volume") + F.col("far.volume")).alias("volume"))


def nearest_front(c: DataFrame) -> DataFrame:
    """(asset, date, front_contract_symbol): the nearest listed month priced that day."""
    return c.groupBy("asset", "date").agg(
        F.min_by("contract_symbol", F.col("expiry_year") * 12 + code_month("expiry_code")).alias("front_contract_symbol"))


def macro(spark: SparkSession, d: str) -> DataFrame:
    """(series, ref_date, value): daily order value by priority."""
    return (
        table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"),
                                          F.to_date("o_orderdate").alias("ref_date"))
        .agg((F.sum(cents("o_totalprice")) / F.lit(100.0)).alias("value"))
    )


def vix(spark: SparkSession, d: str) -> DataFrame:
    """(date, close): average order value per week-ending Friday, scaled; a market-wide gauge."""
    return (
        table(spark, d, "orders").groupBy(week_end(F.to_date("o_orderdate")).alias("date"))
        .agg((F.sum(cents("o_totalprice")) / F.lit(10_000_000.0) / F.count(F.lit(1))).alias("close"))
    )


def regime(spark: SparkSession, d: str) -> DataFrame:
    """(date, regime): tercile of the gauge over the whole sample; cut points are one scalar row."""
    v = vix(spark, d)
    cuts = v.agg(F.percentile("close", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    q = cuts.scalar()
    return v.select("date", F.when(F.col("close") <= q[0], "low").when(F.col("close") <= q[1], "mid")
                    .otherwise("high").alias("regime"))
