import datetime as dt

import numpy as np
import pandas as pd


def long(spark, wide: pd.DataFrame, name="close", key="asset"):
    """Wide frame (date index x assets) to a long Spark panel, missing as NULL."""
    rows = [(a, d.date(), None if pd.isna(v) else float(v)) for a in wide.columns for d, v in wide[a].items()]
    return spark.createDataFrame(rows, f"{key} string, date date, {name} double")


def wide(df, value, key="asset"):
    p = df.select(key, "date", value).toPandas()
    w = p.pivot(index="date", columns=key, values=value)
    w.index = pd.to_datetime(w.index)
    return w.astype(float).sort_index()


def same(a: pd.DataFrame, b: pd.DataFrame, tol=1e-9):
    b = b.reindex(index=a.index, columns=a.columns)
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=tol, atol=tol, equal_nan=True)


def noise(n=120, cols="AB", seed=0, gap=0.1, start="2020-01-01", freq="B", level=100.0):
    rng = np.random.default_rng(seed)
    idx = pd.date_range(start, periods=n, freq=freq)
    w = pd.DataFrame(level * np.exp(np.cumsum(rng.normal(0, 0.02, (n, len(cols))), axis=0)), index=idx, columns=list(cols))
    return w.mask(rng.random(w.shape) < gap)


D = dt.date
