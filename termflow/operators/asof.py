"""As-of joins, publication lags and regime lookups."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from termflow.functions.calendar import business_days
from termflow.functions.cols import keys


def asof_join(left: DataFrame, right: DataFrame, by, left_on: str, right_on: str, cols: list[str], order: str | None = None) -> DataFrame:
    """Latest right row with right_on <= left_on per key.

    The ordered scan runs over distinct (key, date) pairs of both sides, so no key can hold more rows
    than the calendar has days; left rows then pick their match up with an equi-join that AQE may split.
    """
    k = keys(by) if by else []
    pick = F.struct(*cols)
    r = right.groupBy(*k, F.col(right_on).alias("__t")).agg(F.max_by(pick, F.col(order or right_on)).alias("__r"))
    l = left.select(*k, F.col(left_on).alias("__t")).distinct().withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType))
    u = r.withColumn("__s", F.lit(0)).unionByName(l.withColumn("__s", F.lit(1)))
    # Right rows of the same day sort first, so they are visible that day.
    w = W.partitionBy(*(k or [F.lit(0)])).orderBy("__t", "__s").rowsBetween(W.unboundedPreceding, 0)
    hit = u.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__s = 1").select(
        *k, F.col("__t").alias(left_on), "__m")
    j = left.join(hit, [*k, left_on], "left")
    return j.select(*left.columns, *[F.col("__m")[c].alias(c) for c in cols])


def add_business_days(df: DataFrame, date: str, n: int, out: str, cal: DataFrame) -> DataFrame:
    """n business days on; from a non-business day the next business day counts as one."""
    at = cal.select(F.col("date").alias(date), (F.col("bday_no") + n).alias("__k"))
    to = cal.where("is_bday").select(F.col("bday_no").alias("__k"), F.col("date").alias(out))
    j = df.join(at, date, "left").join(to, "__k", "left").drop("__k")
    gone = F.raise_error(F.concat(F.lit("the calendar does not cover "), F.col(date).cast("string"))).cast("date")
    return j.withColumn(out, F.when(F.col(out).isNotNull() | F.col(date).isNull(), F.col(out)).otherwise(gone))


def publish(df: DataFrame, ref: str, rule: str, cal: DataFrame, n: int = 0, out: str = "publish_date") -> DataFrame:
    """Publication date of a reference date: same day, n business days on, or the n-th business day
    after the start of the following month."""
    if rule == "same_day":
        return df.withColumn(out, F.col(ref))
    if rule == "business_days":
        return add_business_days(df, ref, n, out, cal)
    if rule == "next_month":
        x = df.withColumn("__m", F.add_months(F.trunc(ref, "MM"), 1))
        return add_business_days(x, "__m", n, out, cal).drop("__m")
    raise ValueError(rule)


def calendar_for(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    return business_days(spark, first_year, last_year)


def calendar_of(dates: DataFrame, date: str, slack_years: int = 1) -> DataFrame:
    """Business days of all years that the dates are in, and slack_years around them: one scalar aggregate."""
    lo, hi = dates.agg(F.year(F.min(date)), F.year(F.max(date))).first()
    lo, hi = (1970, 1970) if lo is None else (lo, hi)
    return business_days(dates.sparkSession, lo - slack_years, hi + slack_years)


def regime_actions(dates: DataFrame, regimes: DataFrame, actions: DataFrame, books: DataFrame, default: float = 1.0) -> DataFrame:
    """(date, book, active, alpha_multiplier): latest regime on or before each date, then the
    action table; unknown or missing regimes are neutral. dates and books are dimension tables."""
    d = asof_join(dates, regimes, None, "date", "date_r", ["regime"])
    # Each date takes every book through the action table keyed by regime, completed for missing pairs.
    have = books.join(actions, "book", "left").groupBy("book").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("regime").isNotNull(), F.struct(
            "regime", F.struct("active", "alpha_multiplier"))))).alias("m"))
    packed = have.agg(F.collect_list(F.struct("book", "m")).alias("b"))
    x = d.select("date", "regime", F.explode(packed.scalar()).alias("b"))
    hit = F.try_element_at(F.col("b.m"), F.coalesce("regime", F.lit("")))
    return x.select("date", F.col("b.book").alias("book"), "regime", F.coalesce(hit["active"], F.lit(True)).alias("active"),
                    F.coalesce(hit["alpha_multiplier"], F.lit(default)).alias("alpha_multiplier"))


def apply_regime(alpha: DataFrame, acts: DataFrame, x: str = "alpha") -> DataFrame:
    """Scale a book's alpha and drop its inactive dates, before any solve."""
    return (alpha.join(acts.select("date", "book", "active", "alpha_multiplier"), ["date", "book"], "left")
            .where(F.coalesce("active", F.lit(True)))
            .withColumn(x, F.col(x) * F.coalesce("alpha_multiplier", F.lit(1.0))).drop("active", "alpha_multiplier"))
