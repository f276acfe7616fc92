"""Characteristic-managed portfolios and restricted factor fits on an L x L second moment."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from termflow.functions.cols import seq
from termflow.operators.xs import rank_centered


def characteristics(panel: DataFrame, chars: list[str], ret: str = "ret") -> DataFrame:
    """(asset, date, l, z, r): centered ranks per date plus a constant, with the next row's return.

    Assets with any missing characteristic or return on a date are left out of that date.
    """
    x = panel.select("asset", "date", F.lead(ret).over(seq()).alias("r"), *[rank_centered(c).alias(c) for c in chars], F.lit(1.0).alias("const"))
    full = x.dropna("any")
    return full.unpivot(["asset", "date", "r"], [*chars, "const"], "l", "z")


def managed_portfolios(z: DataFrame) -> DataFrame:
    """x = Z'r per (date, l)."""
    return z.groupBy("date", "l").agg(F.sum(F.col("z") * F.col("r")).alias("x"))


def characteristic_products(z: DataFrame) -> DataFrame:
    """Z'Z per (date, l, m). L is the number of characteristics."""
    m = z.select("asset", "date", F.col("l").alias("m"), F.col("z").alias("zm"))
    return z.join(m, ["asset", "date"]).groupBy("date", "l", "m").agg(F.sum(F.col("z") * F.col("zm")).alias("zz"))


def second_moment(x: DataFrame) -> DataFrame:
    y = x.select("date", F.col("l").alias("m"), F.col("x").alias("y"))
    return x.join(y, "date").groupBy("l", "m").agg(F.sum(F.col("x") * F.col("y")).alias("s"))


def loadings(x: DataFrame, k: int) -> DataFrame:
    """(k, l, g): leading eigenvectors of the L x L second moment, the only part that leaves the JVM."""
    def eig(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="l", columns="m", values="s")
        val, vec = np.linalg.eigh(m.to_numpy())
        top = np.argsort(val)[::-1][:k]
        return pd.concat([pd.DataFrame({"k": i, "l": m.index, "g": vec[:, t]}) for i, t in enumerate(top)])
    return second_moment(x).groupBy().applyInPandas(eig, "k int, l string, g double")


def factors(x: DataFrame, gamma: DataFrame) -> DataFrame:
    return x.join(gamma, "l").groupBy("date", "k").agg(F.sum(F.col("x") * F.col("g")).alias("f"))


def residuals(x: DataFrame, gamma: DataFrame) -> DataFrame:
    """d = x - gamma f per (date, l); zero when every direction is kept."""
    fit = factors(x, gamma).join(gamma, "k").groupBy("date", "l").agg(F.sum(F.col("f") * F.col("g")).alias("fit"))
    return x.join(fit, ["date", "l"]).select("date", "l", "x", (F.col("x") - F.col("fit")).alias("d"))


def total_r2(res: DataFrame) -> DataFrame:
    return res.agg((1 - F.sum(F.col("d") * F.col("d")) / F.sum(F.col("x") * F.col("x"))).alias("r2"))


def _solve(zz: pd.DataFrame, d: pd.Series) -> pd.Series:
    m = zz.pivot(index="l", columns="m", values="zz")
    return pd.Series(np.linalg.lstsq(m.to_numpy(), d.reindex(m.index).to_numpy(), rcond=None)[0], index=m.index)


def anomaly_loading(res: DataFrame, zz: DataFrame) -> DataFrame:
    """(l, gamma): mean(Z'Z)^-1 mean(d)."""
    zb = zz.groupBy("l", "m").agg(F.avg("zz").alias("zz"))
    db = res.groupBy("l").agg(F.avg("d").alias("d"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _solve(pdf[["l", "m", "zz"]], pdf.groupby("l")["d"].first())
        return pd.DataFrame({"l": g.index, "gamma": g.to_numpy()})
    return zb.join(db, "l").groupBy().applyInPandas(solve, "l string, gamma double")


def bootstrap_alpha(res: DataFrame, zz: DataFrame, n_boot: int = 1000, seed: int = 0, per_task: int = 50) -> DataFrame:
    """(draw, w): wild-bootstrap values of gamma'gamma. Draws run in parallel; the residual history each one
    resamples has one row per date and characteristic."""
    spark = res.sparkSession
    dd = res.agg(F.array_sort(F.collect_list(F.struct("date", "l", "d"))).alias("a"))
    zb = zz.groupBy("l", "m").agg(F.avg("zz").alias("zz")).agg(F.array_sort(F.collect_list(F.struct("l", "m", "zz"))).alias("a"))
    draws = spark.range(0, n_boot, 1, max(1, n_boot // per_task)).withColumn("chunk", F.floor(F.col("id") / per_task))
    job = draws.groupBy("chunk").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids", dd.scalar().alias("d"), zb.scalar().alias("zz"))

    def run(batches):
        for pdf in batches:
            for ids, d, z in zip(pdf["ids"], pdf["d"], pdf["zz"]):
                m = pd.DataFrame(list(d)).pivot(index="date", columns="l", values="d")
                zp = pd.DataFrame(list(z)).pivot(index="l", columns="m", values="zz")
                inv, v, n = np.linalg.pinv(zp.to_numpy()), m[zp.index].to_numpy(), len(m)
                out = []
                for i in ids:
                    g = np.random.default_rng([seed, int(i)])
                    b = (v[g.integers(0, n, n)] * g.standard_t(5, n)[:, None]).mean(axis=0)
                    w = inv @ b
                    out.append((int(i), float(w @ w)))
                yield pd.DataFrame(out, columns=["draw", "w"])
    return job.mapInPandas(run, "draw long, w double")


def alpha_pvalue(gamma: DataFrame, draws: DataFrame) -> DataFrame:
    obs = gamma.agg(F.sum(F.col("gamma") * F.col("gamma")).alias("w")).scalar()
    return draws.agg(F.avg((F.col("w") >= obs).cast("double")).alias("p_value"), F.max(obs).alias("w_alpha"))


def alpha_signal(z: DataFrame, gamma: DataFrame) -> DataFrame:
    return z.join(gamma, "l").groupBy("asset", "date").agg(F.sum(F.col("z") * F.col("gamma")).alias("signal"))
