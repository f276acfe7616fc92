"""Recursions over event time: rows wait in keyed state until the watermark passes, then fold in date order.

Rows may arrive in any order within the watermark's delay, in one trigger or over several. Each key holds its waiting rows in
list state and one event-time timer at the newest of them; when the timer fires, everything up to it is folded by date. A later
row with an earlier date sets an earlier timer of its own. Of rows with one date the last to arrive before the fold counts;
rows beyond the watermark are dropped. Needs the RocksDB state store (ingest.state_layout).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

Row = tuple[float | None, ...]
#: (state or None, earlier rows, this row) -> (new state, rows to emit)
Step = Callable[[Row | None, list[Row], Row], tuple[Row, list[tuple]]]


def doubles(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


def ordered_fold(name: str, inputs: tuple[str, ...], state: tuple[str, ...], out: tuple[str, ...], step: Step, keep: int = 0):
    """Processor of one recursion over keys called `name`; `keep` earlier rows are held for it as a list."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    waiting_type = StructType([StructField("at", LongType()), *doubles(*inputs).fields])

    class Ordered(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", waiting_type)
            self.value = handle.getValueState("value", doubles(*state))
            self.past = handle.getListState("past", doubles(*inputs)) if keep else None

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            new = [(int(r[0]), *(None if pd.isna(v) else float(v) for v in r[1:]))
                   for pdf in rows for r in pdf[["at", *inputs]].itertuples(index=False, name=None)]
            if new:
                self.waiting.appendList(new)
                self.handle.registerTimer(max(r[0] for r in new))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            due, rest = {}, []
            for r in self.waiting.get() if self.waiting.exists() else ():
                if r[0] <= expiredTimerInfo.getExpiryTimeInMs():
                    due[r[0]] = tuple(r[1:])
                else:
                    rest.append(tuple(r))
            if not due:
                return
            now = self.value.get() if self.value.exists() else None
            past = [tuple(r) for r in self.past.get()] if keep and self.past.exists() else []
            made = []
            for at in sorted(due):
                now, emitted = step(now, past, due[at])
                made += [(key[0], pd.Timestamp(at, unit="ms").date(), *e) for e in emitted]
                if keep:
                    past.append(due[at])
                    del past[:-keep]
            self.value.update(now)
            if keep:
                self.past.put(past)
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            yield pd.DataFrame(made, columns=[name, "date", *out])

        def close(self) -> None:
            pass

    return Ordered()


def run(stream: DataFrame, processor, key: str, inputs: tuple[str, ...], out: str, delay: str, date: str = "date") -> DataFrame:
    """The processor over stream(key, date, inputs)."""
    ts = F.col(date).cast("timestamp")
    s = stream.select(key, ts.alias("ts"), F.unix_millis(ts).alias("at"), *[F.col(c).cast("double").alias(c) for c in inputs])
    return s.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{key} string, date date, {out}", outputMode="append", timeMode="EventTime")


def ewma(stream: DataFrame, com: float, delay: str, key: str = "asset") -> DataFrame:
    """(key, date, ret, ewma_var): running squared-return average; gaps decay the old weight."""
    a = 1.0 / (1.0 + com)

    def step(state, past, row):
        avg, old, last = state or (None, 1.0, None)
        close = row[0]
        r = close / last - 1 if close is not None and last else None
        if r is not None:
            avg = r * r if avg is None else (old * avg + a * r * r) / (old + a)
            old = 1.0
        if avg is not None:
            old *= 1 - a
        return (avg, old, close), [(r, avg)]

    p = ordered_fold(key, ("close",), ("avg", "old", "last"), ("ret", "ewma_var"), step)
    return run(stream, p, key, ("close",), "ret double, ewma_var double", delay)


def kalman(stream: DataFrame, y: str, x: str, delay: str, delta: float = 1e-4, ve: float = 1e-3, warmup: int = 60, key: str = "pair") -> DataFrame:
    """(key, date, alpha, beta): random-walk regression coefficients; a row needs both values."""
    v = delta / (1 - delta)

    def step(state, past, row):
        a, b, p11, p12, p22, n = state or (0.0,) * 6
        h, e = row[1], row[0] - a - b * row[1]
        p11, p22 = p11 + v, p22 + v
        s = p11 + 2 * h * p12 + h * h * p22 + ve
        k1, k2 = (p11 + h * p12) / s, (p12 + h * p22) / s
        a, b = a + k1 * e, b + k2 * e
        p11, p12, p22 = p11 - k1 * (p11 + h * p12), p12 - k1 * (p12 + h * p22), p22 - k2 * (p12 + h * p22)
        return (a, b, p11, p12, p22, n + 1), [(a, b) if n >= warmup else (None, None)]

    p = ordered_fold(key, (y, x), ("a", "b", "p11", "p12", "p22", "n"), ("alpha", "beta"), step)
    return run(stream.where(F.col(y).isNotNull() & F.col(x).isNotNull()), p, key, (y, x), "alpha double, beta double", delay)


def channel(stream: DataFrame, systems: list[tuple[int, int]], delay: str, close: str = "close", key: str = "asset") -> DataFrame:
    """(key, date, system, state) of breakout systems: entry on the long channel, exit on the short one.

    A channel needs all of its earlier rows to have a price; without price or entry channel the state is missing and kept.
    """
    def extremes(past: list[Row], n: int) -> tuple[float | None, float | None]:
        own = [r[0] for r in past[-n:]]
        return (max(own), min(own)) if len(own) == n and None not in own else (None, None)

    def step(state, past, row):
        held, made = list(state or (0.0,) * len(systems)), []
        for i, (long, short) in enumerate(systems):
            (eh, el), (xh, xl), st = extremes(past, long), extremes(past, short), held[i]
            if row[0] is None or eh is None:
                made.append((f"{long}/{short}", None))
                continue
            if st == 0:
                st = 1.0 if row[0] > eh else -1.0 if row[0] < el else 0.0
            elif (st > 0 and xl is not None and row[0] < xl) or (st < 0 and xh is not None and row[0] > xh):
                st = 0.0
            held[i] = st
            made.append((f"{long}/{short}", st))
        return tuple(held), made

    p = ordered_fold(key, (close,), tuple(f"s{i}" for i in range(len(systems))), ("system", "state"), step, keep=max(max(s) for s in systems))
    return run(stream, p, key, (close,), "system string, state double", delay)
