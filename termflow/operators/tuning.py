"""Parameter grids of books: every point's stream, its splits, its test against the default, and what survives correction."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from termflow.functions.cols import keys
from termflow.operators import backtest as bt, book, stats

# Periods per year and EWMA half-life of each rebalance frequency; the default point.
FREQUENCIES = {"monthly": (12.0, 12.0), "weekly": (52.0, 87.0)}
DEFAULT_POINT = "0.1|0.3|weekly"
#: Smaller differences between two streams are rounding.
ROUNDING_DIGITS = 12


def rebalance_dates(panel: DataFrame, frequency: str) -> DataFrame:
    """(date): all panel dates, or the last one of each month."""
    d = panel.select("date").distinct()
    return d if frequency == "weekly" else d.groupBy(F.trunc("date", "month").alias("__m")).agg(F.max("date").alias("date")).select("date")


def grid_inputs(alpha: DataFrame, cov: DataFrame, panel: DataFrame, frequencies=tuple(FREQUENCIES)) -> DataFrame:
    """Book inputs for every frequency in one plan; the book key becomes `book|frequency`."""
    dates = None
    for f in frequencies:
        d = rebalance_dates(panel, f).withColumn("__f", F.lit(f))
        dates = d if dates is None else dates.unionByName(d)
    a = alpha.join(dates, "date").withColumn("book", F.concat_ws("|", "book", "__f")).drop("__f")
    return book.book_inputs(a, cov, panel)


def grid_points(inputs: DataFrame, target_vols, max_weights, **fixed) -> DataFrame:
    """Every (target volatility, weight limit) for every book; half-life and periods follow the book's frequency."""
    points = [dict(fixed, point=f"{v}|{m}", target_vol=v, max_weight=m) for v in target_vols for m in max_weights]
    g, f = book.grid(inputs, points), F.substring_index("book", "|", -1)
    for col, at in (("ppy", 0), ("halflife", 1)):
        value = F.lit(None).cast("double")
        for name, v in FREQUENCIES.items():
            value = F.when(f == name, F.lit(v[at])).otherwise(value)
        g = g.withColumn(col, value)
    return g


def grid_streams(inputs: DataFrame, points: DataFrame, panel: DataFrame, cost_bps: DataFrame | None = None) -> DataFrame:
    """(book, point, date, pnl): panel-date marks of every point's weights; the frequency moves from the book to the point."""
    from termflow.session import materialize
    w = materialize(book.run_books(inputs, points), "grid-weights")
    m = book.daily_mark(w, panel, cost_bps=cost_bps)
    return m.select(F.substring_index("book", "|", 1).alias("book"), F.concat_ws("|", "point", F.substring_index("book", "|", -1)).alias("point"), "date", "pnl")


def paired_hac(pnl: DataFrame, default: str, maxlags: int, by=("book",), point: str = "point", x: str = "pnl") -> DataFrame:
    """(by, point, n, mean, tstat, p_value) of each point's stream minus the default's on the dates that both have.

    The default's value comes by one window over (by, date), so the streams are read once however many points there are.
    Fewer than two lag windows of dates give NULL statistics; the default itself has mean 0 and p 1.
    """
    k = keys(by)
    base = F.max(F.when(F.col(point) == default, F.col(x))).over(W.partitionBy(*k, "date"))
    d = pnl.withColumn("__d", F.round(F.col(x) - base, ROUNDING_DIGITS)).where(F.col("__d").isNotNull() & (F.col(point) != default))
    h = stats.hac_mean(d, (*k, point), "__d", maxlags)
    enough = F.col("n") >= 2 * maxlags
    h = h.select(*k, point, "n", F.when(enough, F.col("mean")).alias("mean"), F.when(enough, F.col("tstat")).alias("tstat"))
    h = h.withColumn("p_value", stats.normal_two_sided(F.col("tstat")))
    own = pnl.where(F.col(point) == default).select(*k, point).distinct()
    return h.unionByName(own.select(*k, point, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(None).cast("double").alias("tstat"), F.lit(1.0).alias("p_value")))


def grid_report(pnl: DataFrame, default: str, train_end: str, val_end: str, maxlags: int, ppy: int = 252) -> DataFrame:
    """One row per (book, point): Sharpe of each split and the validation test against the default.

    A book whose default has no stream has nothing to compare with and is left out.
    """
    t = bt.split_tag(pnl, train_end, val_end, ("book", "point"))
    s = bt.sharpe_by_split(t, ["book", "point"], ppy=ppy)
    h = paired_hac(t.where("split = 'validation'"), default, maxlags)
    known = pnl.where(F.col("point") == default).select("book").distinct()
    out = s.join(known, "book", "left_semi").join(h, ["book", "point"], "left").withColumn("is_default", F.col("point") == default)
    return out.withColumn("improves", F.coalesce(~F.col("is_default") & (F.col("mean") > 0), F.lit(False)))


def candidates(report: DataFrame, size: int | None = None) -> DataFrame:
    """One row per book: its best improving point with the p-value times the number of comparisons; 1 where none improves.

    size: comparisons made in a book; by default the points it has.
    """
    best = stats.best_candidate(report, size=size)
    out = report.select("book").distinct().join(best, "book", "left")
    return out.select("book", "point", "p_raw", F.coalesce("p_bonferroni", F.lit(1.0)).alias("p_bonferroni"), F.col("point").isNotNull().alias("found"))


def adopted(chosen: DataFrame, alpha: float = 0.05) -> DataFrame:
    """False-discovery control across the books' corrected p-values; only a found candidate can be adopted."""
    a = stats.benjamini_hochberg(chosen, "p_bonferroni", alpha)
    return a.withColumn("adopt", F.col("reject") & F.col("found")).withColumnRenamed("p_adj", "p_fdr").drop("reject")


def winner_per_key(table: DataFrame, key, spec: str, score: str, default: str, universe: DataFrame | None = None) -> DataFrame:
    """(key, winner, score): the spec of the largest score of each key, ties to the larger spec name; NULL scores don't count.

    Keys of `universe` (or of the table) without any score get the default spec.
    """
    k = keys(key)
    scored = table.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = scored.groupBy(*k).agg(F.max(F.struct(F.col(score).alias("s"), F.col(spec).alias("w"))).alias("b"))
    every = (table if universe is None else universe).select(*k).distinct()
    return every.join(best, k, "left").select(*k, F.coalesce("b.w", F.lit(default)).alias("winner"), F.col("b.s").alias(score))
