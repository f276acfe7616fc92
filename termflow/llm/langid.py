"""Language identification with interpolated Kneser-Ney character models.

One model per language over folded text (letters kept in lower case, all else a space). Spark counts the n-grams of the
training rows, derives the continuation counts and the discounted masses, and the model is a set of sorted hash
arrays with one log-probability per language. Every n-gram is kept: the arrays are built part by part and lie in files that tasks
map, so that neither the driver nor a task holds them in memory. A text gets the language of the lowest cross-entropy per symbol. The text
is rejected if that language explains it hardly better than a context-free model of all training text does; the
thresholds, one by language and class of length, are calibrated on all training rows. A class without a row has the nearest class's of its language.

Cases: a null text, an empty one and one without a letter are `und` with score 0 and rejected; ties go to the language
first in order; repeated rows are predicted alike; with no training row at all every text is `und`; other columns stay.
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termflow.llm.charlm import EDGE, count_grams, folded, grams, has_letter
from termflow.llm.textarr import HashIndex, mix
from termflow.session import materialize, scratch_path

#: Symbols of context plus one.
ORDER = 4
#: Rows of the model that the driver reads at a time.
PART_ROWS = 1_000_000
#: Symbols at which a class of length begins.
LENGTHS = np.array([20, 40, 80, 160, 320, 640, 1280, 2560])
#: Share of the calibration rows' lower tail, and share of their median advantage, below which a text is rejected.
TAIL, OF_MEDIAN = 0.001, 0.25
#: Symbols at which the posterior of a text no longer sharpens.
SHARPEN = 40


def masses(counts: DataFrame, order: int) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Per order: (grp, key, a) discounted mass of each n-gram, (grp, ctx, lam) weight left to the next lower order."""
    out, c = {}, counts
    for m in range(order, 0, -1):
        if m < order:
            c = c.groupBy("grp", (F.col("key").bitwiseAND(F.lit((1 << 16 * m) - 1))).alias("key")).agg(F.count("*").alias("n"))
        d = c.groupBy("grp").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("n") == 2, 1).otherwise(0)).alias("n2"))
        d = d.select("grp", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5)).alias("d"))
        d = d.withColumn("d", F.least(F.greatest("d", F.lit(0.05)), F.lit(0.95)))
        ctx = c.groupBy("grp", F.shiftrightunsigned("key", 16).alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        ctx = ctx.join(d, "grp").select("grp", "ctx", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("lam"))
        a = c.withColumn("ctx", F.shiftrightunsigned("key", 16)).join(ctx, ["grp", "ctx"]).select("grp", "key", "n", ((F.col("n") - F.col("d")) / F.col("total")).alias("a"))
        out[m] = (a, ctx.select("grp", "ctx", "lam"))
    return out


class Column:
    """An array in a file that grows at its end and is mapped to be read."""

    def __init__(self, path: str, kind: type, width: int = 0):
        self.path, self.kind, self.width, self.n = path, np.dtype(kind), width, 0

    def append(self, x: np.ndarray) -> None:
        with open(self.path, "ab") as f:
            f.write(np.ascontiguousarray(x, self.kind).tobytes())
        self.n += len(x)

    def read(self) -> np.ndarray:
        shape = (self.n, self.width) if self.width else (self.n,)
        if not self.n:
            return np.zeros(shape, self.kind)
        path = self.path if os.path.exists(self.path) else SparkFiles.get(os.path.basename(self.path))
        return np.asarray(np.memmap(path, self.kind, "r", shape=shape))


class Level:
    """Rising hashes with a row of values for each, in files."""

    def __init__(self, path: str, width: int):
        self.hashes, self.first, self.values = Column(f"{path}-hashes", np.uint64), Column(f"{path}-first", np.int64), Column(f"{path}-values", np.float32, width)
        self.shift, self.run = np.uint64(0), 0

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.values.append(values)

    def close(self) -> Level:
        """No more rows: index the leading bits."""
        h, n = self.hashes.read(), self.hashes.n
        bits = max(8, min(22, int(np.ceil(np.log2(n + 1))) + 3))
        self.shift = np.uint64(64 - bits)
        first = np.append(np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << self.shift), n)
        self.run = int(np.max(np.diff(first)))
        self.first.append(first)
        self.hashes.append(np.array([0xFFFFFFFFFFFFFFFF], np.uint64))
        return self

    def open(self) -> tuple[HashIndex, np.ndarray]:
        index = HashIndex.__new__(HashIndex)
        index.padded, index.first, index.shift, index.run = self.hashes.read(), self.first.read(), self.shift, self.run
        index.hashes = index.padded[:-1]
        return index, self.values.read()


#: (language, n-gram or context, value) by rising hash of the second, in parts that share none.
Parts = Callable[[], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


class Model:
    """Sorted hash arrays in files: per order the interpolated log-probability of each known n-gram and the back-off weight of each known context, by language."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[Parts, Parts]], order: int):
        self.languages, self.order = languages, order
        n = len(languages)
        ones = [np.concatenate(x) for x in zip(*tables[1][0](), strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)]
        sym, at = np.unique(ones[1], return_inverse=True)
        self.floor = np.float32(np.log(1.0 / (max(2, len(sym)) + 1)))
        self.files: dict[tuple[str, int], Level] = {}
        self.opened: dict[tuple[str, int], tuple[HashIndex, np.ndarray]] = {}
        spark = SparkSession.active()
        folder = re.fullmatch(r"(?:file:(?://)?)?(/.*)", scratch_path(spark, "char-model"))
        top = folder[1] if folder else tempfile.mkdtemp(prefix="termflow-")  # given out as files of the job
        os.makedirs(top, exist_ok=True)
        name = uuid.uuid4().hex
        for m in range(1, order + 1):
            known, contexts = tables[m]
            level = Level(f"{top}/{name}-context-{m}", n)
            for grp, key, lam in contexts():
                u, inv = np.unique(mix(key), return_inverse=True)
                weight = np.ones((len(u), n))
                weight[inv, grp] = lam
                level.add(u, np.log(weight))
            self.files["context", m] = level.close()
            level = Level(f"{top}/{name}-gram-{m}", n)
            for grp, key, a in known():
                u, first, inv = np.unique(mix(key), return_index=True, return_inverse=True)
                ku = key[first]
                rest = np.exp(self._logp(m - 1, ku & np.uint64((1 << 16 * (m - 1)) - 1)).astype(np.float64)) if m > 1 else np.exp(self.floor)
                p = np.exp(self._weights(m, ku >> np.uint64(16)).astype(np.float64)) * rest
                np.add.at(p, (inv, grp), a)
                level.add(u, np.log(np.maximum(p, 1e-12)))
            self.files["gram", m] = level.close()
        if not folder:
            for level in self.files.values():
                for c in (level.hashes, level.first, level.values):
                    if c.n:
                        spark.sparkContext.addFile(c.path)
        cont = np.bincount(at, weights=ones[2])
        self.plain = np.full(1 << 16, self.floor, np.float32)  # context-free model, by symbol
        if cont.sum() > 0:
            self.plain[sym.astype(np.int64)] = np.log(np.maximum(cont / cont.sum(), 1e-9))
        self.threshold = np.zeros((n, len(LENGTHS) + 1))
        self.scale = np.ones((n, len(LENGTHS) + 1))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": {}}

    def _open(self, what: str, m: int) -> tuple[HashIndex, np.ndarray]:
        if (what, m) not in self.opened:
            self.opened[what, m] = self.files[what, m].open()
        return self.opened[what, m]

    def _weights(self, m: int, ctx: np.ndarray) -> np.ndarray:
        """Log of the weight left to the next lower order; 0 for an unknown context."""
        index, w = self._open("context", m)
        at = index.find(mix(ctx))
        return np.where((at >= 0)[:, None], w[at], np.float32(0)) if len(w) else np.zeros((len(ctx), len(self.languages)), np.float32)

    def _logp(self, m: int, key: np.ndarray) -> np.ndarray:
        if m == 0:
            return np.full((len(key), len(self.languages)), self.floor, np.float32)
        index, p = self._open("gram", m)
        if not len(p):
            return np.full((len(key), len(self.languages)), self.floor, np.float32)
        at = index.find(mix(key))
        miss = np.flatnonzero(at < 0)
        out = p[at]
        if len(miss):
            k = key[miss]
            out[miss] = self._logp(m - 1, k & np.uint64((1 << 16 * (m - 1)) - 1)) + self._weights(m, k >> np.uint64(16))
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: cross-entropy by language, that of the context-free model, number of symbols."""
        n, width = len(texts), len(self.languages)
        ce, plain, size = np.zeros((n, width)), np.zeros(n), np.zeros(n, np.int64)
        for first, end, c, start in folded(texts, self.order):
            key = grams(c, self.order)
            sym = c[self.order - 1:]
            real = sym != EDGE
            p = self._logp(self.order, key)
            p[~real] = 0
            at = np.minimum(start[:-1], max(len(key) - 1, 0))
            if len(key):
                sums = np.concatenate([np.zeros((1, width)), np.cumsum(p, axis=0, dtype=np.float64)])
                stop = np.minimum(start[1:], len(key))
                ce[first:end] = -(sums[stop] - sums[at])
                q = np.concatenate([[0.0], np.cumsum(np.where(real, self.plain[sym], 0), dtype=np.float64)])
                plain[first:end] = -(q[stop] - q[at])
                r = np.concatenate([[0], np.cumsum(real)])
                size[first:end] = r[stop] - r[at]
        by = np.maximum(size, 1)
        return ce / by[:, None], plain / by, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is accepted."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        ce, plain, size = self.entropies(texts)
        letters = np.array([has_letter(t) for t in texts], bool)
        best = np.argmin(ce, axis=1)
        gain = plain - ce[np.arange(len(texts)), best]
        z = -(ce - ce.min(axis=1, keepdims=True)) * np.minimum(size, SHARPEN)[:, None]
        posterior = 1.0 / np.exp(z).sum(axis=1)
        length = np.searchsorted(LENGTHS, size, "right")
        threshold = self.threshold[best, length]
        score = posterior / (1.0 + np.exp(-np.clip((gain - threshold) / self.scale[best, length], -30, 30)))
        score = np.where(letters, np.clip(score, 0, 1), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], score, letters & (gain >= threshold)


def language_tables(counts: DataFrame, order: int, part_rows: int = PART_ROWS) -> tuple[list[str], dict[int, tuple[Parts, Parts]]]:
    """Languages and, per order, the parts that Model takes: every n-gram and context; the driver reads about part_rows rows at a time."""
    counts = materialize(counts, "char-counts")
    languages = sorted(r[0] for r in counts.select("grp").distinct().collect())
    code = {g: i for i, g in enumerate(languages)}
    n = max(1, -(-counts.count() // part_rows))  # no order has more rows than the highest

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = mix(b.column(1).to_numpy().view(np.uint64))
            part = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], ["grp", "key", "value", "part"])

    def parts(rows: DataFrame, name: str) -> Parts:
        dealt = materialize(rows.mapInArrow(deal, "grp string, key long, value double, part int"), name, ("part",))

        def read() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for i in range(n):
                t = dealt.where(F.col("part") == i).toArrow()
                grp = t.column("grp").combine_chunks().dictionary_encode()
                who = np.array([code[g] for g in grp.dictionary.to_pylist()], np.int64)
                if t.num_rows:
                    yield who[grp.indices.to_numpy()], t.column("key").to_numpy().astype(np.int64).view(np.uint64), t.column("value").to_numpy().astype(np.float64)

        return read

    return languages, {m: (parts(a.select("grp", "key", "a"), "char-grams"), parts(ctx.select("grp", "ctx", "lam"), "char-contexts")) for m, (a, ctx) in masses(counts, order).items()}


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", order: int = ORDER) -> Model:
    """Model of every language in `lang`; rows without text or language teach nothing."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    model = Model(*language_tables(count_grams(docs, "text", "lang", order), order), order)
    calibrate(model, docs)
    return model


def calibrate(model: Model, docs: DataFrame) -> None:
    """Thresholds on the gain over the context-free model by language and class of length, from every training row."""
    if not model.languages:
        return
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if has_letter(t)]
            ce, plain, size = shared.value.entropies(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.argmin(ce, axis=1)), pa.array(np.searchsorted(LENGTHS, size, "right")), pa.array(plain - ce.min(axis=1))], ["lang", "length", "gain"])

    found = docs.select("text").mapInArrow(job, "lang long, length long, gain double").groupBy("lang", "length").agg(F.expr(f"percentile_approx(gain, array({TAIL}, 0.5), 10000)").alias("g")).collect()
    have = {(r["lang"], r["length"]): r["g"] for r in found}
    for i in range(len(model.languages)):
        for k in range(len(LENGTHS) + 1):
            near = min(have, key=lambda x: (x[0] != i, abs(x[1] - k), x), default=None)
            if near:
                tail, middle = have[near]
                model.threshold[i, k] = min(tail, OF_MEDIAN * middle)
                model.scale[i, k] = max(0.02, (middle - model.threshold[i, k]) / 6)


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_accepted")) -> DataFrame:
    """docs with the language, its score and whether it is accepted; columns of these names are replaced."""
    docs = docs.drop(*names)
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, ok = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(ok)], [*b.schema.names, *names])

    out = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return docs.mapInArrow(job, out)


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text falls on the part kept from training; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(True))
