"""Keyed upserts, versioned overwrites and audit appends on shared storage."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def last_wins(parts: list[DataFrame], key: list[str], arrival: str | None = None) -> DataFrame:
    """Union where later parts win per key, and within a part the row of the largest `arrival`.

    The order rows have in memory or files says nothing about their arrival, so it is a column; without one, and on ties, the
    greatest row wins, which any rerun repeats. One map-side max_by, nothing is ranked.
    """
    u = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        u = p if u is None else u.unionByName(p, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in (*key, "__part")]
    order = F.struct("__part", *([arrival] if arrival else []), *[c for c in rest if c != arrival])
    return u.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__v")).select(*key, "__v.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class PartitionedTable:
    """Keyed table of which an upsert rewrites only the partitions that hold new rows.

    Each row keeps the batch and the arrival it came with; of a key the largest (batch, arrival) stays. So a replayed
    batch, or one that arrives after a later one, changes nothing, and a write that broke off is mended by repeating it. A key must
    stay in its partition: derive the partition from key columns.
    """

    #: Columns the table adds.
    META = ("__batch", "__arrival", "__partition")

    def __init__(self, root: str, key: list[str], partition: Column):
        self.root, self.key, self.partition = root, key, partition

    def upsert(self, new: DataFrame, batch: int, arrival: str) -> list[str]:
        """Merge a batch; `arrival` orders its rows and is not stored under its own name. Returns the partitions it wrote."""
        from termflow.session import materialize
        x = new.withColumn("__batch", F.lit(batch).cast("long")).withColumn("__arrival", F.col(arrival))
        x = materialize(x.drop(arrival).withColumn("__partition", self.partition.cast("string")), "upsert-batch")
        # partitions (days, months, hash buckets) are few beside rows
        touched = [r[0] for r in x.select("__partition").distinct().collect()]
        if not touched:
            return []
        if exists(x.sparkSession, self.root):
            mine = F.col("__partition").isin([t for t in touched if t is not None])  # prunes folders: the rest is not read
            x = x.unionByName(self._all(x.sparkSession, x.schema).where(mine | F.col("__partition").isNull() if None in touched else mine))
        rest = [c for c in x.columns if c not in (*self.key, *self.META)]
        order = F.struct("__batch", "__arrival", *rest)
        one = x.groupBy("__partition", *self.key).agg(F.max(order).alias("v")).select(*self.key, "v.*", "__partition")
        merged = materialize(one, "upsert-merged")  # the folders below are read by it
        merged.hint("rebalance", "__partition").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__partition").parquet(self.root)
        return sorted("" if t is None else t for t in touched)

    def _all(self, spark: SparkSession, schema: StructType | None = None) -> DataFrame:
        # the folder's values stay text: a month must not come back as a date
        if schema is None:
            schema = StructType([f for f in spark.read.parquet(self.root).schema.fields if f.name != "__partition"] + [StructField("__partition", StringType())])
        return spark.read.schema(schema).parquet(self.root)

    def read(self, spark: SparkSession, meta: bool = False) -> DataFrame:
        df = self._all(spark)
        return df if meta else df.drop(*self.META)


def write_version(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a new version folder, then publish it by one small pointer append.

    Readers follow the newest pointer, so a failed write never shows.
    """
    path = f"{root}/v-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    spark = df.sparkSession
    spark.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{root}/current")
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    path = spark.read.parquet(f"{root}/current").agg(F.max_by("path", "at").alias("path")).first()["path"]
    return spark.read.parquet(path)


def upsert(new: DataFrame, root: str, key: list[str], exists: bool, partition_by: tuple[str, ...] = (), arrival: str | None = None) -> DataFrame:
    """Existing rows plus new ones, new wins on the key; published as a new version of the whole table.

    For tables small enough to be rewritten; PartitionedTable rewrites only what a batch touches.
    """
    spark = new.sparkSession
    df = last_wins([read_current(spark, root), new], key, arrival) if exists else last_wins([new], key, arrival)
    write_version(df, root, partition_by)
    return read_current(spark, root)


def append_audit(rows: DataFrame, root: str, run: str) -> DataFrame:
    """Append-only run log."""
    rows.withColumn("run_id", F.lit(run)).write.mode("append").parquet(root)
    return rows.sparkSession.read.parquet(root)


def export(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("errorifexists")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
