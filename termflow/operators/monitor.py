"""Run health and macro snapshot tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def freshness(last_run: Column, now: str, stale_hours: int = 48) -> Column:
    age = F.unix_timestamp(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_timestamp(last_run.cast("timestamp"))
    return F.when(last_run.isNull(), "UNKNOWN").when(age <= stale_hours * 3600, "OK").otherwise("STALE")


def pipeline_health(manifest: DataFrame, now: str, stale_hours: int = 48) -> DataFrame:
    """Latest run per job with its worst status; manifest(job, run_date, item, status)."""
    last = manifest.groupBy("job").agg(F.max("run_date").alias("run_date"))
    g = manifest.join(last, ["job", "run_date"]).groupBy("job", F.col("run_date").alias("last_run")).agg(
        F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("status") == "OK", 1)).alias("ok"),
        F.count(F.when(F.col("status") == "ERROR", 1)).alias("failed"))
    fresh = freshness(F.col("last_run"), now, stale_hours)
    st = F.when(F.col("failed") == F.col("items"), "FAILED").when(F.col("ok") < F.col("items"), "PARTIAL").otherwise(fresh)
    return g.withColumn("status", F.when(fresh == "STALE", fresh).otherwise(st))


def macro_latest(values: DataFrame, as_of: str, manifest: DataFrame | None = None) -> DataFrame:
    """Latest published value per source; values(source, ref_date, publish_date, value)."""
    v = values.where(F.col("publish_date") <= F.to_date(F.lit(as_of)))
    g = v.groupBy("source").agg(F.max("ref_date").alias("value_date"), F.max_by("value", "ref_date").alias("value"))
    every = values.select("source").distinct().join(g, "source", "left").withColumn(
        "data_status", F.when(F.col("value_date").isNull(), "NO_DATA_AVAILABLE").otherwise("OK"))
    if manifest is None:
        return every
    m = manifest.groupBy("source").agg(F.max_by("status", "run_date").alias("job_status"))
    return every.join(m, "source", "left").withColumn("job_status", F.coalesce("job_status", F.lit("UNKNOWN")))
