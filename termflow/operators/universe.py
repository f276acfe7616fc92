"""Universe, sector and coverage operators: aggregates, semi and anti joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from termflow.functions.cols import div

# Sectors and members, blocked assets, redundant assets, the liquidity floor.
SECTORS = {
    "Energy": ["WTI Crude", "Brent", "Natural Gas", "RBOB", "HeatingOil"],
    "PreciousMetals": ["Gold", "Silver", "Platinum", "Palladium"],
    "IndustrialMetals": ["Copper"],
    "Grains": ["Corn", "Soybeans", "Wheat", "KC_Wheat", "Rice", "Oats"],
    "Softs": ["Coffee", "Sugar", "Cocoa", "Cotton", "OrangeJuice"],
    "Livestock": ["LiveCattle", "LeanHogs", "FeederCattle"],
    "EquityIndex": ["SP500", "Nasdaq100", "Dow", "Russell2000"],
    "Rates": ["US_2Y", "US_5Y", "US_10Y", "US_30Y", "UltraBond"],
    "FX": ["EURUSD", "JPYUSD", "GBPUSD", "AUDUSD", "CADUSD", "SwissFranc", "MexicanPeso"],
}
BLOCKED = ("Coffee", "Cotton", "OrangeJuice")
PROXY_ASSETS = ("Coffee", "Sugar", "Cocoa", "Cotton", "OrangeJuice")
REDUNDANT_ALL = ("Dow", "UltraBond", "US_5Y")
REDUNDANT_TREND = ("Brent", "KC_Wheat")
MIN_ADV = 1000.0


def sector_table(spark: SparkSession, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    return spark.createDataFrame([(a, s) for s, m in sectors.items() for a in m], "asset string, sector string")


def redundant_table(spark: SparkSession) -> DataFrame:
    """(asset, scope) for compress: redundant in every family, or for trend signals only."""
    rows = [(a, "all") for a in REDUNDANT_ALL] + [(a, "trend") for a in REDUNDANT_TREND]
    return spark.createDataFrame(rows, "asset string, scope string")


def blocked_table(spark: SparkSession) -> DataFrame:
    """(asset) for liquid_universe: never traded, whatever the volume."""
    return spark.createDataFrame([(a,) for a in BLOCKED], "asset string")


def proxy_table(spark: SparkSession) -> DataFrame:
    """(asset) for carry_panel: without quoted spreads, so carry comes from the next contract's price."""
    return spark.createDataFrame([(a,) for a in PROXY_ASSETS], "asset string")


def liquid_universe(bars: DataFrame, start: str, threshold: float = MIN_ADV, blocked: DataFrame | None = None) -> DataFrame:
    """(asset, adv, included): average volume since start against a floor; blocked assets never pass."""
    a = bars.where(F.col("date") >= F.to_date(F.lit(start))).groupBy("asset").agg(F.avg("volume").alias("adv"))
    a = a.withColumn("included", F.col("adv") >= threshold)
    if blocked is None:
        return a
    b = blocked.select("asset", F.lit(True).alias("__b"))
    return a.join(b, "asset", "left").withColumn("included", F.col("included") & F.col("__b").isNull()).drop("__b")


def compress(universe: DataFrame, redundant: DataFrame, family: str) -> DataFrame:
    """Drop assets redundant for a family; redundant(asset, scope) with scope all or trend."""
    if family not in ("trend", "rank"):
        raise ValueError("family must be trend or rank")
    drop = redundant if family == "trend" else redundant.where("scope = 'all'")
    return universe.join(drop, "asset", "left_anti")


def mask_untrusted(panel: DataFrame, since: DataFrame, fields: list[str]) -> DataFrame:
    """Null values before each asset's trusted date; rows stay."""
    j = panel.join(since, "asset", "left")
    keep = F.col("trusted_since").isNull() | (F.col("date") >= F.col("trusted_since"))
    return j.withColumns({f: F.when(keep, F.col(f)) for f in fields}).drop("trusted_since")


def active_assets(panel: DataFrame, alpha: str, ret: str, min_frac: float = 0.9) -> DataFrame:
    """Assets with some alpha and enough return coverage."""
    g = panel.groupBy("asset").agg(F.count(alpha).alias("n_alpha"), (F.count(ret) / F.count(F.lit(1))).alias("coverage"))
    return g.where((F.col("n_alpha") > 0) & (F.col("coverage") >= min_frac))


def with_sector(df: DataFrame, sectors: DataFrame) -> DataFrame:
    return df.join(sectors, "asset")


def sector_correlations(panel: DataFrame, x: str, until: str) -> DataFrame:
    """Pair correlations inside each sector, from second moments of same-day members.

    A sector's members on a date are few by registry; pairs meet by equality on (sector, date).
    """
    t = panel.where((F.col("date") <= F.to_date(F.lit(until))) & F.col(x).isNotNull()).select("sector", "date", "asset", x)
    b = t.select("sector", "date", F.col("asset").alias("asset_b"), F.col(x).alias("__y"))
    j = t.withColumnRenamed("asset", "asset_a").join(b, ["sector", "date"]).where("asset_a < asset_b")
    sd = F.stddev_samp(x) * F.stddev_samp("__y")
    return j.groupBy("sector", "asset_a", "asset_b").agg(F.when(sd > 0, F.covar_samp(x, "__y") / sd).alias("corr"), F.count(F.lit(1)).alias("n"))


def flagged_pairs(corr: DataFrame, redundant: float = 0.95, directional: float = 0.85) -> DataFrame:
    tier = F.when(F.col("corr") >= redundant, "near_duplicate").when(F.col("corr") >= directional, "directional")
    return corr.withColumn("tier", tier).where("tier is not null")


def keep_liquid_leg(pairs: DataFrame, adv: DataFrame) -> DataFrame:
    """Of a redundant pair, keep the more liquid asset."""
    a = adv.select(F.col("asset").alias("asset_a"), F.col("adv").alias("adv_a"))
    b = adv.select(F.col("asset").alias("asset_b"), F.col("adv").alias("adv_b"))
    first = F.coalesce(F.col("adv_a") >= F.col("adv_b"), F.lit(True))
    return pairs.join(a, "asset_a", "left").join(b, "asset_b", "left").withColumn(
        "keep", F.when(first, F.col("asset_a")).otherwise(F.col("asset_b"))).withColumn("drop", F.when(first, F.col("asset_b")).otherwise(F.col("asset_a")))


def sector_coverage(sectors: DataFrame, kept: DataFrame, min_members: int = 2) -> DataFrame:
    j = sectors.join(kept.select("asset", F.lit(1).alias("__k")).distinct(), "asset", "left")
    return j.groupBy("sector").agg(F.count(F.lit(1)).alias("members"), F.count("__k").alias("kept")).withColumn("ok", F.col("kept") >= min_members)


def session_gaps(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Expected sessions inside each asset's span minus those observed.

    sessions(calendar, date) is a calendar dimension; bars carry their calendar name.
    """
    span = bars.groupBy("asset", "calendar").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("rows"))
    # Both ends of each span take their place among the calendar's sessions; no asset meets every session.
    own = sessions.select("calendar", "date").distinct()
    ends = span.select("asset", "calendar", F.explode(F.array(F.struct(F.col("start").alias("date"), F.lit(0).alias("o")), F.struct(F.col("end").alias("date"), F.lit(2).alias("o")))).alias("p"))
    points = ends.select("asset", "calendar", "p.*").unionByName(own.withColumn("o", F.lit(1)).withColumn("asset", F.lit(None).cast("string")))
    w = W.partitionBy("calendar").orderBy("date", "o").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = points.withColumn("n", F.sum((F.col("o") == 1).cast("long")).over(w)).where("o <> 1")
    exp = at.groupBy("asset").agg(F.sum(F.when(F.col("o") == 2, F.col("n")).otherwise(-F.col("n"))).alias("expected"))
    seen = bars.select("asset", "calendar", "date").distinct().join(own, ["calendar", "date"], "left_semi").groupBy("asset").agg(F.count(F.lit(1)).alias("seen"))
    j = span.join(exp, "asset", "left").join(seen, "asset", "left").withColumn("missing", F.col("expected") - F.coalesce("seen", F.lit(0)))
    return j.select("asset", "start", "end", "rows", "expected", "missing", div("missing", "expected").alias("missing_pct"))


def date_range_preset(df: DataFrame, preset: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """1Y / 5Y / 10Y back from the last date, max, or custom bounds."""
    if preset == "max":
        return df
    if preset == "custom":
        return df.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    last = df.agg(F.max("date").alias("d")).scalar()
    return df.where(F.col("date") >= F.add_months(last, -12 * int(preset.rstrip("Y"))))
