"""Structured Streaming counterparts: bars, keyed ingest, dimension enrichment."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from termflow.session import scratch_path


def refresh_window(last_date, overlap_days: int, today):
    """Date range of an incremental pull: re-pull the last few days so corrections arrive."""
    import datetime as dt
    start = last_date - dt.timedelta(days=overlap_days)
    return start, today


def cycle_id(day) -> str:
    """Label of the weekly cycle: the most recent Friday."""
    import datetime as dt
    return (day - dt.timedelta(days=(day.weekday() - 4) % 7)).isoformat()


def events(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """File stream; without max_files a trigger takes all that has landed."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def daily_bars(stream: DataFrame, ts: str = "ts", key: str = "event_type", px: str = "value", watermark: str = "2 hours") -> DataFrame:
    """Tumbling daily bars; rows later than the watermark are dropped, a day is emitted once closed."""
    o = F.struct(F.col(ts), F.col("event_id"))
    return (stream.withWatermark(ts, watermark).groupBy(F.window(ts, "1 day"), key)
            .agg(F.min_by(px, o).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, o).alias("close"), F.count(F.lit(1)).alias("n"))
            .select(F.to_date("window.start").alias("date"), key, "open", "high", "low", "close", "n"))


def enrich(stream: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Stream-static join with a dimension table; unmatched rows stay."""
    return stream.join(dim, key, "left")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_layout(spark: SparkSession, rocks: bool = False):
    """State partitions no more than the cluster's task slots, and the RocksDB store where it is needed."""
    want = {"spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))}
    if rocks:
        want["spark.sql.streaming.stateStore.providerClass"] = ROCKS
    old = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class UpsertSink:
    """foreachBatch target: folds each micro-batch to its last row per key, then writes it as an idempotent part named by batch id.

    A replayed batch overwrites its own part and changes nothing. When a batch starts, all earlier ones are committed, so every
    `compact_every` batches their parts are merged into a keyed table that rewrites only the hash buckets they touch; a pointer row
    tells up to which batch. Readers take that table and the parts after it. A merge that broke off is repeated without harm.
    """

    def __init__(self, root: str, key: list[str], order: str, compact_every: int | None = None, buckets: int = 64):
        from termflow.sources.sinks import PartitionedTable
        self.root, self.key, self.order, self.compact_every = root, key, order, compact_every
        self.base = PartitionedTable(f"{root}/base", key, F.pmod(F.hash(*key), F.lit(buckets)))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.compact_every and batch_id and batch_id % self.compact_every == 0:
            self.compact(batch.sparkSession, batch_id - 1)
        rest = [c for c in batch.columns if c not in self.key]
        one = batch.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(self.order, *rest)).alias("v")).select(*self.key, "v.*")
        one.write.mode("overwrite").parquet(f"{self.root}/parts/batch={batch_id}")

    def compacted(self, spark: SparkSession) -> int:
        """Last batch that the keyed table holds, -1 for none."""
        from termflow.sources.sinks import exists
        path = f"{self.root}/compacted"
        return (spark.read.parquet(path).agg(F.max("upto")).first()[0]) if exists(spark, path) else -1

    def parts(self, spark: SparkSession, after: int, upto: int | None = None) -> DataFrame:
        p = spark.read.parquet(f"{self.root}/parts").where(F.col("batch") > after)
        return p if upto is None else p.where(F.col("batch") <= upto)

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Merge the parts up to a committed batch. The order column decides, so batches may be merged in any order."""
        done = self.compacted(spark)
        if upto <= done:
            return
        new = self.parts(spark, done, upto)
        self.base.upsert(new.withColumn("__order", F.struct(self.order, "batch")).drop("batch"), 0, "__order")
        spark.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("append").parquet(f"{self.root}/compacted")

    def table(self, spark: SparkSession) -> DataFrame:
        """Current rows: the largest order column wins per key, then the last batch."""
        done = self.compacted(spark)
        df = self.parts(spark, done)
        if done >= 0:
            df = df.unionByName(self.base.read(spark).withColumn("batch", F.lit(done).cast(df.schema["batch"].dataType)))
        rest = [c for c in df.columns if c not in (*self.key, "batch")]
        return df.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(self.order, "batch")).alias("v")).select(*self.key, "v.*")


def pull(source: DataFrame, last_date, overlap_days: int, today, date: str = "date", label: str = "cycle") -> DataFrame:
    """Rows of one refresh: from the overlap before the last pulled date up to today, with the cycle they came in."""
    start, end = refresh_window(last_date, overlap_days, today)
    return source.where((F.col(date) >= F.lit(start)) & (F.col(date) <= F.lit(end))).withColumn(label, F.lit(cycle_id(today)))


def run_slices(slices: list[DataFrame], make, spark: SparkSession, sink=None, name: str = "stream") -> str:
    """Land one slice after the other and drain each before the next: a trigger takes a whole slice, however many files it has.

    make(stream) builds the query; its checkpoint and output go on from slice to slice.
    """
    path, ck, out = (scratch_path(spark, f"{name}-{x}") for x in ("landing", "checkpoint", "out"))
    for s in slices:
        s.write.mode("append").parquet(path)
        out = run_available(make(events(spark, path, s.schema)), spark, sink, name, ck=ck, out=out)
    return out


def run_available(df: DataFrame, spark: SparkSession, sink=None, name: str = "stream", mode: str = "append", ck: str | None = None, out: str | None = None) -> str:
    """Drain what has landed and stop; returns the output folder (parquet) or the sink's root."""
    ck = ck or scratch_path(spark, f"{name}-checkpoint")
    w = df.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).outputMode(mode)
    if sink is not None:
        q: StreamingQuery = w.foreachBatch(sink).start()
        out = sink.root
    else:
        out = out or scratch_path(spark, f"{name}-out")
        q = w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return out
