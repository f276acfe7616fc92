"""Raw bars and instrument definitions to priced, labelled rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termflow.functions.calendar import month_code

# The undefined-price marker and the fixed-point price scale.
UNDEF_PRICE = 9_223_372_036_854_775_807
PRICE_SCALE = 1_000_000_000
OHLC = ("open", "high", "low", "close")


def dedup_definitions(defs: DataFrame, arrival: str = "arrival") -> DataFrame:
    """First-arrived definition per (date, instrument_id), one whole row of those that arrived together: the least."""
    rest = [c for c in defs.columns if c not in ("date", "instrument_id", arrival)]
    first = F.min(F.struct(arrival, *rest)).alias("__d")
    return defs.groupBy("date", "instrument_id").agg(first).select("date", "instrument_id", *[F.col("__d")[c].alias(c) for c in rest])


def define_bars(bars: DataFrame, defs: DataFrame, arrival: str = "arrival", one_a_day: bool = False) -> DataFrame:
    """Definition of the same day, else the instrument's latest earlier one; `match` tells which.

    Both steps are one as-of scan over the distinct (instrument, date) pairs of the two sides, so a
    hot instrument is at most one row per day when it is ordered; the bars then join by equality.
    one_a_day: the bars are known to be distinct by (instrument, date), so the scan runs over the bars themselves and the
    join is spared; the result is the same for any bars.
    """
    rest = [c for c in defs.columns if c not in ("date", "instrument_id", arrival)]
    d = dedup_definitions(defs, arrival).select("instrument_id", "date", F.struct(F.col("date").alias("def_date"), *rest).alias("m"))
    if one_a_day:
        own = F.struct(*bars.columns)
        known = d.where("m.raw_symbol is not null and instrument_id is not null and date is not null")
        u = bars.select("instrument_id", "date", own.alias("b")).unionByName(known, allowMissingColumns=True)
        # a definition is no bar, and comes before the bar of its day
        scan = W.partitionBy("instrument_id").orderBy("date", F.col("b").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
        hit = u.withColumn("m", F.last("m", ignorenulls=True).over(scan)).where("b is not null")
        return _labelled(hit.select("b.*", "m"), bars.columns, rest)
    need = bars.select("instrument_id", "date").distinct()
    u = need.join(d, ["instrument_id", "date"], "full")
    w = W.partitionBy("instrument_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    # A definition whose symbol is missing does not count as an exact match.
    u = u.withColumn("m", F.when(F.col("m.raw_symbol").isNotNull(), F.col("m")))
    hit = u.select("instrument_id", "date", F.last("m", ignorenulls=True).over(w).alias("m"))
    return _labelled(bars.join(hit, ["instrument_id", "date"], "left"), bars.columns, rest)


def _labelled(j: DataFrame, own: list[str], rest: list[str]) -> DataFrame:
    """Bars with their definition's columns and how it was found."""
    how = F.when(F.col("m").isNull(), "none").when(F.col("m.def_date") == F.col("date"), "exact").otherwise("fallback")
    return j.select(*own, how.alias("match"), *[F.col("m")[c].alias(c) for c in rest])


def has_sentinel() -> Column:
    e = F.col(OHLC[0]) == UNDEF_PRICE
    for c in OHLC[1:]:
        e = e | (F.col(c) == UNDEF_PRICE)
    return e


def scale_prices(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) / PRICE_SCALE for c in OHLC})


def exact_zero() -> Column:
    e = F.col(OHLC[0]) == 0
    for c in OHLC[1:]:
        e = e | (F.col(c) == 0)
    return e


def z_variant() -> Column:
    return F.col("raw_symbol").endswith("_Z")


def instrument_kind() -> Column:
    return F.when(F.col("instrument_class") == "F", "outright").when(F.col("instrument_class") == "S", "combo").otherwise("other")


def ohlc_violation() -> Column:
    o, h, l, c = (F.col(x) for x in OHLC)
    return (h < l) | (h < o) | (h < c) | (l > o) | (l > c)


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def quality_counters(outrights: DataFrame, by: list[str]) -> DataFrame:
    """One conditional pass over clean outrights."""
    bad = (F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)
    return outrights.groupBy(*by).agg(
        F.count(F.lit(1)).alias("outright_rows"), count_if(bad).alias("non_positive_price_rows"),
        count_if(F.col("volume") == 0).alias("zero_volume_outright_rows"), count_if(ohlc_violation()).alias("ohlc_violation_rows"))


def contract_symbol(root: str, code: str | Column, year: str | Column, exchange: str) -> Column:
    y = F.col(year) if isinstance(year, str) else year
    c = F.col(code) if isinstance(code, str) else code
    return F.concat(F.col(root), c, F.lpad((y % 100).cast("string"), 2, "0"), F.lit("."), F.col(exchange))


def outright_rows(outrights: DataFrame) -> DataFrame:
    """Term-structure rows: delivery letter and contract symbol from the maturity columns."""
    x = outrights.withColumn("expiry_code", month_code("maturity_month"))
    return x.select("date", *OHLC, "volume", "asset", contract_symbol("root", "expiry_code", "maturity_year", "exchange").alias("contract_symbol"),
                    "root", "exchange", "expiry_code", F.col("maturity_year").alias("expiry_year"))


def clean_rows(defined: DataFrame, ice: Column | None = None) -> DataFrame:
    """Known symbols only, sentinels out, prices scaled, kind tagged; outrights also lose `_Z`
    variants (where ice) and exact zeros."""
    x = scale_prices(defined.where(F.col("raw_symbol").isNotNull() & ~has_sentinel())).withColumn("kind", instrument_kind())
    drop = exact_zero() if ice is None else (exact_zero() | (ice & z_variant()))
    return x.where(~((F.col("kind") == "outright") & drop))
