"""The panels most operators start from."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termflow.operators.backtest import backtest, positions
from termflow.operators.panel import densify, simple_return
from termflow.operators.signals.trend import raw_momentum_rows
from termflow.operators.vol import realized_vol
from termflow.operators.xs import vol_targeted_sign
from termflow.session import materialize
from termflow.sources import driver_views as dv


def panel_w(spark: SparkSession, d: str) -> DataFrame:
    """Dense weekly panel. Bars are written once and read back, so the raw rows are scanned once although
    the calendar, the asset list and the cells all derive from them."""
    return densify(materialize(dv.bars_w(spark, d), "bars-w"), dims=("sector",))


def panel_d(spark: SparkSession, d: str) -> DataFrame:
    return densify(materialize(dv.bars_d(spark, d).drop("n", "cents"), "bars-d"), dims=("sector",))


def ret_w(spark: SparkSession, d: str) -> DataFrame:
    return panel_w(spark, d).withColumn("ret", simple_return("close"))


def vol_w(spark: SparkSession, d: str) -> DataFrame:
    return ret_w(spark, d).withColumn("vol", realized_vol("ret", 26, ppy=52))


def mom_w(spark: SparkSession, d: str) -> DataFrame:
    return vol_w(spark, d).withColumn("mom", raw_momentum_rows("close", 12))


def sig_w(spark: SparkSession, d: str) -> DataFrame:
    """Weekly time-series momentum signal with its inputs."""
    return mom_w(spark, d).withColumn("signal", vol_targeted_sign("mom", "vol", 0.40))


def pos_w(spark: SparkSession, d: str) -> DataFrame:
    return positions(sig_w(spark, d), "signal", "daily")


def pnl_w(spark: SparkSession, d: str) -> DataFrame:
    return backtest(pos_w(spark, d), "pos", "ret")
