"""Calendar columns and small date dimensions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from termflow.functions.cols import col

# Futures delivery-month letters, January to December.
MONTH_CODES = "FGHJKMNQUVXZ"
# Fixed value: mean days per month in carry arithmetic.
DAYS_PER_MONTH = 30.44


def week_end(d: str | Column) -> Column:
    """The Friday that ends d's week (d itself when it is a Friday)."""
    return F.next_day(F.date_sub(col(d), 1), "FRI")


def month_idx(d: str | Column) -> Column:
    d = col(d)
    return F.year(d) * 12 + F.month(d)


def period_label(d: str | Column, freq: str) -> Column:
    """Calendar label of d's period: Friday, calendar month-end, or the day itself."""
    if freq == "weekly":
        return week_end(d)
    if freq == "monthly":
        return F.last_day(col(d))
    if freq == "daily":
        return col(d)
    raise ValueError("freq must be daily, weekly or monthly")



def month_code(month: str | Column) -> Column:
    return F.substring(F.lit(MONTH_CODES), col(month), F.lit(1))


def nth_weekday(year: Column, month: int, dow: str, n: int) -> Column:
    """n-th weekday of a month, e.g. the third Monday of January."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), dow), 7 * (n - 1))


def observed(d: Column) -> Column:
    """US federal observance: Saturday moves to Friday, Sunday to Monday."""
    dow = F.dayofweek(d)
    return F.when(dow == 7, F.date_sub(d, 1)).when(dow == 1, F.date_add(d, 1)).otherwise(d)


def us_federal_holidays(years: DataFrame) -> DataFrame:
    """(holiday) rows for a `year` column, by rule: fixed dates observed, floating weekdays."""
    y = F.col("year")

    def fixed(m, d):
        return observed(F.make_date(y, F.lit(m), F.lit(d)))

    last_mon_may = F.date_sub(F.next_day(F.make_date(y, F.lit(5), F.lit(31)), "MON"), 7)
    days = [
        fixed(1, 1), nth_weekday(y, 1, "MON", 3), nth_weekday(y, 2, "MON", 3), last_mon_may,
        F.when(y >= 2021, fixed(6, 19)), fixed(7, 4), nth_weekday(y, 9, "MON", 1),
        nth_weekday(y, 10, "MON", 2), fixed(11, 11), nth_weekday(y, 11, "THU", 4), fixed(12, 25),
    ]
    return years.select(F.explode(F.array(*days)).alias("holiday")).where("holiday is not null").distinct()


def business_days(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(date, is_bday, bday_no): bday_no counts business days up to and including date.

    One row per calendar day of the year range, so its size is set by the calendar alone.
    """
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    days = years.select("year", F.explode(F.sequence(
        F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("date"))
    hol = us_federal_holidays(spark.range(first_year, last_year + 2).select(F.col("id").cast("int").alias("year")))
    flagged = days.join(hol, F.col("date") == F.col("holiday"), "left").select(
        "year", "date", (F.col("holiday").isNull() & ~F.dayofweek("date").isin(1, 7)).cast("int").alias("b"))
    # Number within the year, then add the earlier years' totals: no all-rows window.
    in_year = F.sum("b").over(W.partitionBy("year").orderBy("date"))
    totals = flagged.groupBy("year").agg(F.sum("b").alias("tot"))
    offs = totals.select("year", F.coalesce(F.sum("tot").over(
        W.orderBy("year").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    return flagged.withColumn("k", in_year).join(offs, "year").select(
        "date", (F.col("b") == 1).alias("is_bday"), (F.col("k") + F.col("off")).alias("bday_no"))


def code_month(code: str | Column) -> Column:
    """Month number 1..12 of a delivery letter; NULL when unknown."""
    return F.nullif(F.position(col(code), F.lit(MONTH_CODES)), F.lit(0))
