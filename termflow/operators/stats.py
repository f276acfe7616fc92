"""Overfitting and inference statistics, long by config and combination."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from termflow.functions.cols import avg_rank, keys


def normal_two_sided(z: Column) -> Column:
    """P(|N(0, 1)| > |z|) as a column: the density's series near the centre, its continued fraction in the tail."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    term = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda acc, i: F.struct(
        (acc.t * x * x / (2 * i + 1)).alias("t"), (acc.s + acc.t * x * x / (2 * i + 1)).alias("s")), lambda acc: acc.s)
    tail = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda acc, i: x + i / acc)
    return F.when(x < 3, 1 - 2 * density * term).otherwise(2 * density / tail)


def date_blocks(dates: DataFrame, n: int) -> DataFrame:
    """(date, g, h, m): contiguous near-equal blocks 0..n-1, position in the block, block size."""
    b = dates.withColumn("g", F.ntile(n).over(W.partitionBy(F.lit(0)).orderBy("date")) - 1)
    w = W.partitionBy("g")
    return b.withColumn("h", F.row_number().over(w.orderBy("date"))).withColumn("m", F.count(F.lit(1)).over(w))


def combinations(spark: SparkSession, n: int, k: int) -> DataFrame:
    """(combo): bit masks of n blocks with k bits set."""
    return spark.range(2 ** n).where(F.bit_count("id") == k).select(F.col("id").alias("combo"))


def train_rule(n: int, purge: int, embargo: int) -> tuple[Column, Column]:
    """(is_train_block, keep) for columns combo, g, h, m: the head is trimmed after a test block, the tail
    before one; a block that would vanish keeps nothing."""
    train = F.expr("(shiftright(combo, g) & 1) = 1")
    head = F.when(F.expr("g > 0 and (shiftright(combo, g - 1) & 1) = 0"), purge + embargo).otherwise(0)
    tail = F.when(F.expr(f"g < {n - 1} and (shiftright(combo, g + 1) & 1) = 0"), purge).otherwise(0)
    return train, (F.col("m") > head + tail) & (F.col("h") > head) & (F.col("h") <= F.col("m") - tail)


def with_combos(blocks: DataFrame, n: int, k: int) -> DataFrame:
    """Every date with every combination's mask: C(n, k) masks held as one literal array."""
    masks = [i for i in range(2 ** n) if bin(i).count("1") == k]
    return blocks.withColumn("combo", F.explode(F.array(*[F.lit(i) for i in masks])))


def purged_dates(dates: DataFrame, n: int = 8, k: int | None = None, purge: int = 5, embargo: int = 5) -> DataFrame:
    """(combo, date, side): kept training dates and untouched test dates."""
    b = with_combos(date_blocks(dates, n), n, k or n // 2)
    train, keep = train_rule(n, purge, embargo)
    return b.withColumn("side", F.when(train & keep, "train").when(~train, "test")).where("side is not null").select("combo", "date", "side")


def sharpe_stat(x: Column, min_obs: int = 20, ppy: int = 252) -> Column:
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= min_obs) & (sd > 0), F.avg(x) / sd * math.sqrt(ppy))


def block_moments(pnl: DataFrame, blocks: DataFrame, purge: int, embargo: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, config, g, n0..n3, s0..s3, q0..q3): count, sum and squared deviations of every block, whole and trimmed.

    Variant 1 loses its head (the block before it is tested), 2 its tail (the block after it is), 3 both; a block that would
    vanish keeps nothing.
    """
    x = pnl.join(blocks, "date")
    aggs = []
    for v in range(4):
        head, tail = (purge + embargo) * (v & 1), purge * (v >> 1)
        kept = F.when((F.col("m") > head + tail) & (F.col("h") > head) & (F.col("h") <= F.col("m") - tail), F.col("pnl"))
        aggs += [F.count(kept).alias(f"n{v}"), F.coalesce(F.sum(kept), F.lit(0.0)).alias(f"s{v}"), F.coalesce(F.var_pop(kept) * F.count(kept), F.lit(0.0)).alias(f"q{v}")]
    return x.groupBy(*by, "config", "g").agg(*aggs)


def combined_sharpe(n: Column, total: Column, inner: Column, outer: Column, min_obs: int, ppy: int) -> Column:
    """Sharpe of merged blocks: inner squared deviations plus those of the block means (outer = sum of s^2 / n)."""
    m2 = inner + F.greatest(outer - total * total / n, F.lit(0.0))
    return F.when((n >= min_obs) & (m2 > 0), total / n / F.sqrt(m2 / (n - 1)) * math.sqrt(ppy))


def split_stats(pnl: DataFrame, n: int, k: int, purge: int, embargo: int, by: tuple[str, ...] = (), min_obs: int = 20, ppy: int = 252) -> DataFrame:
    """(by, combo, config, is_stat, oos_stat) from block moments: P&L rows are read once and never multiplied by combinations."""
    masks = [i for i in range(2 ** n) if bin(i).count("1") == k]
    b = block_moments(pnl, date_blocks(pnl.select("date").distinct(), n), purge, embargo, by)
    c = b.withColumn("combo", F.explode(F.array(*[F.lit(i) for i in masks])))
    bit = lambda i: F.expr(f"(shiftright(combo, {i}) & 1) = 1")
    train = bit("g")
    variant = F.when(F.expr("g > 0") & ~bit("g - 1"), 1).otherwise(0) + F.when(F.expr(f"g < {n - 1}") & ~bit("g + 1"), 2).otherwise(0)

    def pick(name: str) -> Column:
        return F.element_at(F.array(*[F.col(f"{name}{v}") for v in range(4)]), F.when(train, variant).otherwise(0) + 1)

    c = c.select(*by, "config", "combo", train.alias("tr"), pick("n").alias("n"), pick("s").alias("s"), pick("q").alias("q"))

    def side(own: Column) -> Column:
        cnt = F.sum(F.when(own, F.col("n")).otherwise(0))
        outer = F.sum(F.when(own & (F.col("n") > 0), F.col("s") * F.col("s") / F.col("n")).otherwise(0.0))
        return combined_sharpe(cnt, F.sum(F.when(own, F.col("s")).otherwise(0.0)), F.sum(F.when(own, F.col("q")).otherwise(0.0)), outer, min_obs, ppy)

    return c.groupBy(*by, "combo", "config").agg(side(F.col("tr")).alias("is_stat"), side(~F.col("tr")).alias("oos_stat"))


def cscv(pnl: DataFrame, n: int = 8, k: int | None = None, purge: int = 5, embargo: int = 5, stat=None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, combo, winner, omega, logit): in-sample winner and its out-of-sample relative rank.

    pnl(by, date, config, pnl). The Sharpe ratio is put together from block moments. Another `stat` is any aggregate of a column;
    then each P&L row meets the masks once and is aggregated map-side to (combo, config).
    """
    grp = [*by, "combo"]
    if stat is None:
        s = split_stats(pnl, n, k or n // 2, purge, embargo, by)
    else:
        sides = purged_dates(pnl.select("date").distinct(), n, k, purge, embargo)
        packed = sides.groupBy("date").agg(F.collect_list(F.struct("combo", "side")).alias("c"))
        x = pnl.join(packed, "date").select(*by, "config", "pnl", F.explode("c").alias("c")).select(*by, "config", "pnl", "c.*")
        v = F.col("pnl")
        s = x.groupBy(*by, "combo", "config").agg(stat(F.when(F.col("side") == "train", v)).alias("is_stat"), stat(F.when(F.col("side") == "test", v)).alias("oos_stat"))
    w = W.partitionBy(*grp)
    s = s.withColumn("rk", avg_rank("oos_stat", *grp)).withColumn("n_configs", F.count(F.lit(1)).over(w)).withColumn("n_oos", F.count("oos_stat").over(w))
    best = s.where("is_stat is not null").withColumn("o", F.row_number().over(w.orderBy(F.desc("is_stat"), "config"))).where("o = 1")
    ok = best.where(F.col("rk").isNotNull() & (F.col("n_configs") - F.col("n_oos") <= 0.5 * F.col("n_configs")))
    om = F.greatest(F.least(F.col("rk") / (F.col("n_configs") + 1), F.lit(1 - 1e-6)), F.lit(1e-6))
    return ok.select(*grp, F.col("config").alias("winner"), om.alias("omega")).withColumn("logit", F.ln(F.col("omega") / (1 - F.col("omega"))))


def pbo(res: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return res.groupBy(*by).agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("combos"))


def cscv_summary(res: DataFrame, default: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of combinations the default wins and the most frequent winner."""
    c = res.groupBy(*by, "winner").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*by).agg((F.sum(F.when(F.col("winner") == default, F.col("n")).otherwise(0)) / F.sum("n")).alias("default_share"),
                              F.max_by("winner", F.struct("n", "winner")).alias("top_winner"), F.max("n").alias("top_wins"))


def hac_mean(df: DataFrame, by, x: str, maxlags: int, order: str = "date") -> DataFrame:
    """Mean and its autocorrelation-robust t-statistic with declining lag weights."""
    k = keys(by)
    v = df.where(F.col(x).isNotNull())
    e = v.withColumn("__e", F.col(x) - F.avg(x).over(W.partitionBy(*k)))
    s = _hac_sum(e, k, "__e", maxlags, order).alias("__s")
    n = F.count(F.lit(1))
    lagged = e.withColumns({f"__l{l}": F.lag("__e", l).over(W.partitionBy(*k).orderBy(order)) for l in range(1, maxlags + 1)})
    g = lagged.groupBy(*k).agg(n.alias("n"), F.avg(x).alias("mean"), s)
    return g.select(*k, "n", "mean", F.when(F.col("__s") > 0, F.col("mean") * F.col("n") / F.sqrt("__s")).alias("tstat"))


def _hac_sum(df: DataFrame, k: list[str], e: str, maxlags: int, order: str) -> Column:
    out = F.sum(F.col(e) * F.col(e))
    for l in range(1, maxlags + 1):
        out = out + 2 * (1 - l / (maxlags + 1)) * F.coalesce(F.sum(F.col(e) * F.col(f"__l{l}")), F.lit(0.0))
    return out


def hac_slope(df: DataFrame, by, y: str, x: str, maxlags: int, order: str = "date") -> DataFrame:
    """Slope of y on x with constant, robust t-statistic of the slope and R2."""
    k = keys(by)
    w = W.partitionBy(*k)
    v = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    b = F.covar_pop(y, x).over(w) / F.var_pop(x).over(w)
    v = v.withColumn("__b", b).withColumn("__dx", F.col(x) - F.avg(x).over(w)).withColumn("__u", F.col(y) - F.avg(y).over(w) - F.col("__b") * F.col("__dx"))
    v = v.withColumn("__e", F.col("__dx") * F.col("__u"))
    v = v.withColumns({f"__l{l}": F.lag("__e", l).over(w.orderBy(order)) for l in range(1, maxlags + 1)})
    g = v.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.first("__b").alias("slope"), F.sum(F.col("__dx") * F.col("__dx")).alias("sxx"),
                          _hac_sum(v, k, "__e", maxlags, order).alias("__s"), (1 - F.sum(F.col("__u") * F.col("__u")) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))
    return g.select(*k, "n", "slope", F.when(F.col("__s") > 0, F.col("slope") * F.col("sxx") / F.sqrt("__s")).alias("tstat"), "r2")


def best_candidate(points: DataFrame, by=("book",), p: str = "p_value", size: int | None = None) -> DataFrame:
    """Within a book: improving points with a p-value only, the smallest p times the comparisons made (all rows, or `size`)."""
    n = F.lit(size).cast("long") if size else F.count(F.lit(1)).over(W.partitionBy(*by))
    x = points.withColumn("__n", n).where(F.col("improves") & F.col(p).isNotNull())
    return x.groupBy(*by).agg(F.min_by("point", F.struct(p, "point")).alias("point"), F.min(p).alias("p_raw"), F.max("__n").alias("n_points")).withColumn(
        "p_bonferroni", F.least(F.lit(1.0), F.col("p_raw") * F.col("n_points")))


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05, family: tuple[str, ...] = ()) -> DataFrame:
    """Adjusted p and rejection across a family of tests."""
    part = [F.col(c) for c in family] or [F.lit(0)]
    w = W.partitionBy(*part)
    r = df.withColumn("__k", F.row_number().over(w.orderBy(p))).withColumn("__q", F.col(p) * F.count(F.lit(1)).over(w) / F.col("__k"))
    r = r.withColumn("p_adj", F.least(F.lit(1.0), F.min("__q").over(w.orderBy(F.desc("__k")).rowsBetween(W.unboundedPreceding, 0))))
    return r.withColumn("reject", F.col("p_adj") <= alpha).drop("__k", "__q")
