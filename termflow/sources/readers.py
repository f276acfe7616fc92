"""Declared-schema readers for landed files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from termflow.functions.cols import ffill

RAW_BARS = "ts_event string, instrument_id long, open long, high long, low long, close long, volume long, symbol string"
DEFINITIONS = "instrument_id long, raw_symbol string, instrument_class string, asset string, maturity_year int, maturity_month int"
TERM_STRUCTURE = ("date date, open double, high double, low double, close double, volume long, asset string, contract_symbol string, "
                  "root string, exchange string, expiry_code string, expiry_year int")
CONTINUOUS = ("date date, asset string, front_contract_symbol string, raw_open double, raw_high double, raw_low double, raw_close double, "
              "volume long, is_roll_date boolean, adj_open double, adj_high double, adj_low double, adj_close double")
# Yield curve tenors, price-index countries and their quarterly publishers.
TENORS = ("6M", "1Y", "2Y", "3Y", "5Y", "7Y", "10Y", "20Y", "30Y")
CPI_COUNTRIES = ("US", "EUR", "JPY", "GBP", "AUD", "CAD", "CHF", "MXN")
CPI_FILL_ROWS = 2


def dated_csv(spark: SparkSession, path: str, schema: str, pattern: str = r"(\d{8})", columns: list[str] | None = None) -> DataFrame:
    """CSV files whose date is in the file name; only the asked-for columns are parsed."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), "yyyyMMdd")
    return df.select(*(columns or df.columns), day.alias("date"))


def mask_bad_prints(panel: DataFrame, bad: DataFrame, fields: list[str]) -> DataFrame:
    """Null the listed cells; bad(asset, date) is a patch table."""
    j = panel.join(bad.select("asset", "date", F.lit(True).alias("__bad")), ["asset", "date"], "left")
    return j.withColumns({f: F.when(F.col("__bad").isNull(), F.col(f)) for f in fields}).drop("__bad")


def continuous(spark: SparkSession, path: str, adjusted: bool = False) -> DataFrame:
    """Continuous curve fields, raw (with the roll flag, missing is false) or back-adjusted."""
    df = spark.read.schema(CONTINUOUS).parquet(path)
    p = "adj" if adjusted else "raw"
    cols = [F.col(f"{p}_{c}").alias(c) for c in ("open", "high", "low", "close")]
    flag = [] if adjusted else [F.coalesce("is_roll_date", F.lit(False)).alias("is_roll_date")]
    return df.select("asset", "date", *cols, "volume", *flag)


def outrights(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Outright contract bars in their declared layout; only the asked-for columns are read."""
    df = spark.read.schema(TERM_STRUCTURE).parquet(path)
    return df.select(*columns) if columns else df


def wide_series_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Date plus one column per series, read wide and returned long."""
    schema = "Date date, " + ", ".join(f"`{c}` double" for c in columns)
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.unpivot("Date", [F.col(f"`{c}`") for c in columns], "series", "value").withColumnRenamed("Date", "date")


def fill_publishers(cpi: DataFrame, limit: int = CPI_FILL_ROWS) -> DataFrame:
    """Carry each series at most `limit` rows."""
    return cpi.withColumn("value", ffill("value", "series", limit=limit))


def rate_series(rates: DataFrame, rate_type: str, arrival: str = "arrival") -> DataFrame:
    """One rate type, the last arrived duplicate per date."""
    return rates.where(F.col("rate_type") == rate_type).groupBy("date").agg(F.max_by("rate", arrival).alias("rate"))


def dated_parts(df: DataFrame, year="year", month="month", day="day") -> DataFrame:
    return df.withColumn("date", F.make_date(year, month, day)).drop(year, month, day)


def trusted_since(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("asset string, trusted_since date").option("header", True).csv(path)


def monthly_mean(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Month means of every column, months with any empty column dropped."""
    return daily.groupBy(F.trunc("date", "MM").alias("date")).agg(*[F.avg(c).alias(c) for c in columns]).dropna("any")


def outer_series(long: DataFrame, names: list[str]) -> DataFrame:
    """Outer join of several dated series as one pivot; dates with no value at all drop out."""
    return long.groupBy("date").pivot("series", names).agg(F.max("value")).dropna("all", subset=names)


def pivot_last(df: DataFrame, by: str, name: str, names: list[str], x: str, order: str) -> DataFrame:
    return df.groupBy(by).pivot(name, names).agg(F.max_by(x, order))
