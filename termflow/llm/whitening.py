"""Whitening of embeddings: covariance summed exactly in Spark, eigenvectors by mixed-precision refinement.

Entries become integers, x = floor(64 c) + 1000000. Tasks centre them at the whole part of the mean and add up integer sums and
products, so the covariance is an exact fraction. Its float32 eigenvectors are corrected by Ogita and Aishima's iteration
(a few matrix products each, extended precision), which doubles the correct digits. Eigenvalues closer than the
iteration's own error bound are a cluster: it can't turn vectors inside one, so each cluster is projected, shifted by its mean and
solved as a small problem of its own, after which its eigenvalues part. Only d x d numbers reach the driver.

Cases: a vector that is null, empty or holds null, NaN or infinity is dropped; a shorter vector is filled with zeros; a null id stays a
row; repeated rows count again; equal eigenvalues give any basis of their space; an eigenvalue that is zero to working precision has
whitened null and takes no part in identity_error; explained is 0 where all variance is 0; a deviation beyond a long is
null; entries beyond 2**44 are set to it; an empty table gives an empty result; other columns take no part.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termflow.session import materialize

SCALE, OFFSET, TOP = 64, 1_000_000, 32
#: Most iterations; float32 start, quadratic convergence: four or five are used.
MAX_STEPS = 20
EXACT, LONG = 1 << 53, (1 << 63) - 1
#: Larger entries (after scaling) are set to this.
LIMIT = float(1 << 50)
WIDE = np.longdouble
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    v = F.col(column)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    ok = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    return ok.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + OFFSET).alias("x"))


def matrix(batch: pa.RecordBatch, base: np.ndarray) -> np.ndarray:
    """x - base as integers, a row for each vector; missing entries are 0 before the offset."""
    x = batch.column("x")
    sizes, flat = x.value_lengths().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(x) * len(base) and (sizes == len(base)).all():
        m = flat.reshape(len(x), len(base))
    else:
        m = np.full((len(x), len(base)), OFFSET, np.int64)
        m[np.repeat(np.arange(len(x)), sizes), np.concatenate([np.arange(k) for k in sizes])] = flat
    return m - base


def products(y: np.ndarray) -> np.ndarray:
    """y'y exactly."""
    if len(y) and int(np.abs(y).max()) ** 2 * len(y) < EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def moments(data: DataFrame, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of y = x - base and of y'y over all rows as Python integers; each task sends its own sums."""
    d = len(base)
    i, j = np.triu_indices(d)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, g = np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            y = matrix(b, base)
            s, g = s + y.sum(axis=0).astype(object), g + products(y)
        if any(s) or g.any():
            cell = [*range(d), *(d + i * d + j).tolist()]
            yield pa.record_batch([pa.array(cell, pa.int64()), pa.array([str(v) for v in [*s, *g[i, j]]])], names=["cell", "v"])

    sums = data.select("x").mapInArrow(job, "cell long, v string").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    s, g = np.zeros(d, object), np.zeros((d, d), object)
    for cell, v in sums.collect():
        if cell < d:
            s[cell] = int(v)
        else:
            a, b = divmod(cell - d, d)
            g[a, b] = g[b, a] = int(v)
    return s, g


def wide(value: Fraction) -> np.longdouble:
    """To extended precision: the double nearest, and what it leaves."""
    high = float(value)
    return WIDE(high) + WIDE(float(value - Fraction(high)))


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Indexes of runs of sorted values with steps of at most `gap`, of two members or more."""
    order = np.argsort(values)
    runs = np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1)
    return [r for r in runs if len(r) > 1]


def improve(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step: better vectors, their eigenvalues and the size of the correction."""
    d = len(a)
    r = np.eye(d, dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(r))
    bound = 2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + np.abs(value).max() * np.sqrt((r ** 2).sum()))
    step = value[None, :] - value[:, None]
    apart = np.abs(step) > bound
    e = np.where(apart, (s + value[None, :] * r) / np.where(apart, step, 1), r / 2)
    x = x + x @ e
    size = float(np.abs(e).max())
    for own in clusters(value, bound):
        part = x[:, own]
        mid = value[own].mean()
        small = part.T @ (a @ part) - mid * (part.T @ part)
        most = np.abs(small).max()
        if most > 0:
            _, turn = np.linalg.eigh(((small + small.T) / (2 * most)).astype(np.float64))
            x[:, own] = part @ turn.astype(WIDE)
            off = np.abs(small - np.diag(np.diag(small))).max()
            size = max(size, float(off / most) if off > np.finfo(WIDE).eps * np.abs(value).max() * d else 0.0)
    return x, value, size


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix in extended precision."""
    d = len(a)
    top = np.abs(a).max()
    if top == 0:
        return np.zeros(d, WIDE), np.eye(d, dtype=WIDE)
    a = a / top
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    for _ in range(MAX_STEPS):
        x, _, size = improve(a, x)
        if size < 1e-17 * d:
            break
    for _ in range(2):  # turns inside clusters are double precision; Newton-Schulz makes the whole basis orthonormal again
        x = x + x @ (np.eye(d, dtype=WIDE) - x.T @ x) / 2
    value = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    return value[order] * top, x[:, order]


def totals(data: DataFrame, d: int) -> list[int]:
    """Sum of x by dimension."""
    base = np.full(d, OFFSET, np.int64)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros(d, object), 0
        for b in batches:
            s, n = s + matrix(b, base).sum(axis=0).astype(object), n + b.num_rows
        yield pa.record_batch([pa.array(range(d + 1), pa.int32()), pa.array([str(v) for v in [*s, n]])], names=["i", "v"])

    rows = dict(data.select("x").mapInArrow(job, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect())
    n = int(rows[d])
    return [int(rows[i]) + n * OFFSET for i in range(d)]


def fit(data: DataFrame) -> dict | None:
    """Exact n, sums and covariance of data (vec_id, x); its eigenvalues and vectors."""
    n, d = data.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return None
    base = np.array([v // n for v in totals(data, d)], np.int64)
    t, g = moments(data, base)
    cov = np.array([[wide(Fraction(n * int(g[i, j]) - int(t[i]) * int(t[j]), n * n)) for j in range(d)] for i in range(d)], WIDE)
    value, vectors = eigen(cov)
    trace = sum(cov[i, i] for i in range(d))
    return {"n": n, "base": base, "rest": [int(v) for v in t], "value": value, "vectors": vectors, "trace": trace}


def projector(model: dict, top: int) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]:
    """A function from y to whitened rows (NaN for components without variance), and the kept eigenvalues."""
    value, d = model["value"][:top], len(model["base"])
    live = value > max(model["value"].max(), 0) * d * 2.0 ** -60
    with np.errstate(all="ignore"):
        factor = np.where(live, model["vectors"][:, :top] / np.sqrt(np.where(live, value, 1)), np.nan).astype(np.float64)
    centre = np.array([float(Fraction(t, model["n"])) for t in model["rest"]])
    return (lambda y: (y.astype(np.float64) - centre) @ factor), np.asarray(live)


def identity_error(data: DataFrame, model: dict, top: int) -> float:
    """Largest entry of |covariance of the whitened rows - identity|."""
    project, live = projector(model, top)
    k, base = int(live.sum()), model["base"]
    if not k:
        return 0.0

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, g = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = project(matrix(b, base))[:, live]
            s, g = s + w.sum(axis=0), g + w.T @ w
        yield pa.record_batch([pa.array(range(k + k * k), pa.int64()), pa.array(np.concatenate([s, g.ravel()]))], names=["cell", "v"])

    got = np.zeros(k + k * k)
    for cell, v in data.select("x").mapInArrow(job, "cell long, v double").groupBy("cell").agg(F.sum("v")).collect():
        got[cell] = v
    mean = got[:k] / model["n"]  # whitened rows are centred already; this is rounding
    return float(np.abs(got[k:].reshape(k, k) / model["n"] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, top: int = TOP, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    data = materialize(whole(vectors, id_col, column), "whitening-vectors")
    model = fit(data)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    n, base, rest = model["n"], model["base"], model["rest"]
    top = min(top, len(base))
    error = identity_error(data, model, top)
    trace = model["trace"]
    explained = np.array([float(v / trace) if trace > 0 else 0.0 for v in model["value"][:top]])
    project, _ = projector(model, top)

    def deviation(y: np.ndarray) -> list[int | None]:
        most = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
        if most * most * len(base) < LONG:
            return ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(a) - t) ** 2 for a, t in zip(row, rest)) for row in y.tolist()]
        return [v if v <= LONG else None for v in exact]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = matrix(b, base)
            m = len(y) * top
            w = project(y).ravel()
            yield pa.record_batch([
                pa.array(b.column("vec_id").take(pa.array(np.repeat(np.arange(len(y)), top)))), pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), len(y))),
                pa.array(np.full(m, n, np.int64)), pa.array(deviation(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(y)), top))),
                pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, len(y))), pa.array(np.full(m, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return data.mapInArrow(job, OUT)
