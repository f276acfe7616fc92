"""Toxicity scores on deobfuscated text.

A noisy channel restores disguised words: each token with a look-alike symbol, separator, doubled letter or letter of another
alphabet, and each run of letters set apart, becomes a lattice of what each character may stand for, and Viterbi decoding under a
character trigram model, counted over all texts, picks the restored spelling. The restored text is scored: words and word beginnings
carry the lower confidence bound of their log-odds in labelled rows, and a logistic function of the strongest ones
gives the score.

Cases: a null or empty text has no feature and gets the score of such texts (the intercept's); ties in decoding go to
the earlier reading; repeated rows score alike; without labelled rows of both kinds every score is the share of toxic ones (0 if none);
other columns stay.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termflow.llm.charlm import EDGE, SPACE, count_grams, fold_table
from termflow.llm.langid import Model, language_tables
from termflow.llm.textarr import blocks, prefixes, tokens
from termflow.session import materialize

#: Labelled rows the classifier is fitted on, drawn by hash (all, if fewer).
FIT_ROWS = 24_000
#: Hash cells of the word statistics.
CELL_BITS = 20
#: Lengths in bytes of the word beginnings used besides whole words.
BEGINNINGS = (4, 5, 6)

# Usual look-alike symbols and what they stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
SEPARATORS = " .-_*~^'"

#: Nats: a look-alike, a dropped separator, a dropped repetition (alone, in a run of three or more), a symbol that parts words, a dropped symbol.
COST_LOOK, COST_GAP, COST_REPEAT, COST_LONG, COST_BREAK, COST_DROP = 1.0, 0.5, 4.5, 0.3, 2.0, 6.0
BEAM = 48
#: Longer words are decoded in pieces.
PIECE = 256
#: Words, and n-grams, that a task's process remembers.
MEMORY = 1 << 17

#: Letters of other alphabets that look like Latin ones.
ALIKE = dict(zip("аеорсухіјѕԁкмтвнοαεινρυτκ", "aeopcyxijsdkmtbhoaeivputk", strict=True))
#: Characters without width.
UNSEEN = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]+")

_LOOK = "0-9@$|+€£¡!("
#: Letters set apart by separators or white space of any kind.
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[\s.\-_*~^']{1,3}[^\W_](?![^\W_])){2,80}")
#: Words that may be disguised: a look-alike or separator beside a letter (a closing mark of punctuation is none), a doubled
#: letter, alphabets mixed. The costs decide what is read.
_ODD = re.compile(
    rf"[^\W\d_][{_LOOK}*._\-~^']+[^\W_]|[{_LOOK}*]+[^\W\d_]|[^\W\d_][0-9@$|+€£]|([^\W\d_])\1|[a-z][\u0370-\u052f]|[\u0370-\u052f][a-z]", re.I)

#: Punctuation that may stand around a word without disguising it.
_AROUND = ".,;:!?\"'()[]«»…"


class Channel:
    """Decodes disguised words under a character model."""

    def __init__(self, model: Model):
        self.model = model
        self.fold = fold_table()
        self.known: dict[int, float] = {}  # plain tables: freed with the channel at once
        self.told: dict[str, str] = {}

    def logp(self, key: int) -> float:
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            got = self.known[key] = float(self.model._logp(self.model.order, np.array([key], np.uint64))[0, 0])
        return got

    def token(self, word: str) -> str:
        got = self.told.get(word)
        if got is None:
            if len(self.told) >= MEMORY:
                self.told.clear()
            got = self._token(word)
            if len(word) <= 64:
                self.told[word] = got
        return got

    def _readings(self, text: str, i: int) -> list[tuple[str, float]]:
        """What the character may stand for, with its cost; "" drops it."""
        c = text[i]
        out = []
        if c.isalpha():
            out.append((c, 0.0))
            if c in ALIKE:
                out.append((ALIKE[c], COST_LOOK))
            if i and text[i - 1] == c:
                long = (i > 1 and text[i - 2] == c) or text[i + 1:i + 2] == c
                out.append(("", COST_LONG if long else COST_REPEAT))
        else:
            gap = c in SEPARATORS or c.isspace()
            out += [(x, COST_LOOK) for x in LOOKS.get(c, "")]
            if gap:
                out.append(("", COST_GAP))
            out.append((" ", 2 * COST_BREAK if c in LOOKS else COST_BREAK if gap else 0.0))
            out.append(("", COST_DROP))
        return out

    def decode(self, text: str) -> tuple[float, str]:
        """Score and spelling of the best path through the lattice of readings."""
        low, logp, fold = text.lower(), self.logp, self.fold
        beam: dict[int, tuple[float, str]] = {EDGE << 16 | SPACE: (0.0, "")}
        for i in range(len(low)):
            after: dict[int, tuple[float, str]] = {}
            for said, cost in self._readings(low, i):
                sym = int(fold[ord(said)]) if said else 0
                for state, (score, out) in beam.items():
                    if not said or (sym == SPACE and state & 0xFFFF == SPACE):
                        new, s = state, score - cost
                    else:
                        key = state << 16 | sym
                        new, s, out = key & 0xFFFFFFFF, score - cost + logp(key), out + said
                    old = after.get(new)
                    if old is None or s > old[0]:
                        after[new] = (s, out)
            beam = dict(sorted(after.items(), key=lambda kv: -kv[1][0])[:BEAM]) if len(after) > BEAM else after
        ends = [(v[0] + (logp(k << 16 | SPACE) if k & 0xFFFF != SPACE else 0.0), v[1].strip()) for k, v in beam.items()]
        return max(ends, key=lambda e: e[0])

    def _token(self, word: str) -> str:
        if not _ODD.search(word):
            return word
        core = word.strip(_AROUND)
        low = core.lower()
        if core.isalpha() and len(low) == len(core) and not ALIKE.keys() & set(low):
            pairs = [i for i in range(len(low) - 1) if low[i] == low[i + 1]]
            if len(pairs) == 1:
                return word if self._keeps(low, pairs[0]) else word.replace(core, low[:pairs[0]] + low[pairs[0] + 1:], 1)
        return "".join([self.decode(word[i:i + PIECE])[1] for i in range(0, len(word), PIECE)])

    def _keeps(self, low: str, i: int) -> bool:
        """What decode() finds for letters of which only low[i] and the next are equal: its two paths differ in three terms."""
        prev, b, c = (int(self.fold[ord(x)]) for x in (low[i - 1] if i else " ", low[i], low[i + 2] if i + 2 < len(low) else " "))
        before = prev << 16 | b
        return self.logp(before << 16 | b) + self.logp((b << 16 | b) << 16 | c) >= self.logp(before << 16 | c) - COST_REPEAT

    def restore(self, text: str) -> str:
        """The text with each disguised word in its most likely spelling; white space between words becomes one space."""
        if not text.isascii():
            text = UNSEEN.sub("", text)
        text = _APART.sub(lambda m: f" {self.decode(m[0])[1]} ", text)
        return " ".join([self.token(w) for w in text.split()])


class Features:
    """Hash cells of the words and word beginnings of restored texts."""

    def __init__(self, channel: Model | None, bits: int = CELL_BITS):
        """Without a channel the texts are taken as restored already."""
        self.channel, self.shift = channel and Channel(channel), np.uint64(64 - bits)

    def restored(self, column: pa.Array) -> pa.Array:
        return pa.array([t and self.channel.restore(t) for t in column.to_pylist()], pa.string()) if self.channel else column

    def cells(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end, row, cell) for blocks of restored texts."""
        for first, end, data, off in blocks(self.restored(column)):
            t = tokens(data, off)
            row, cell = [t["row"]], [t["hash"]]
            for size in BEGINNINGS:
                at, h = prefixes(t, size)
                row.append(t["row"][at])
                cell.append(h)
            yield first, end, np.concatenate(row), (np.concatenate(cell) >> self.shift).astype(np.int64)


def summary(weights: np.ndarray, row: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """Per row: the largest weight, the second of a different feature, log of 1 + how many are strong."""
    out = np.zeros((n, 3))
    w = weights[cell]
    strong = w > 0.5
    if not strong.any():
        return out
    pair = np.unique((row[strong].astype(np.int64) << 32) | cell[strong])
    r, w = pair >> 32, weights[pair & 0xFFFFFFFF]
    order = np.lexsort((-w, r))
    r, w = r[order], w[order]
    start = np.flatnonzero(np.diff(r, prepend=-1))
    out[r[start], 0] = w[start]
    second = start + 1
    ok = (second < len(r)) & (r[np.minimum(second, len(r) - 1)] == r[start])
    out[r[start][ok], 1] = w[second[ok]]
    out[:, 2] = np.log1p(np.bincount(r[w > 2.0], minlength=n))
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, smooth: float = 0.5, z: float = 1.64) -> np.ndarray:
    """Lower confidence bound of each cell's log-odds of standing in a toxic row; not below 0."""
    odds = np.log((toxic + smooth) / (n_toxic + 2 * smooth)) - np.log((clean + smooth) / (n_clean + 2 * smooth))
    return np.maximum(0, odds - z * np.sqrt(1 / (toxic + smooth) + 1 / (clean + smooth))) * (toxic > 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton fit; the intercept is first."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Scorer:
    def __init__(self, channel: Model, weights: np.ndarray, coef: np.ndarray | None, base: float):
        self.channel, self.at, self.kept, self.coef, self.base, self.cells = channel, np.flatnonzero(weights), weights[weights != 0], coef, base, len(weights)
        self.held: tuple[Features, np.ndarray] | None = None

    def ready(self) -> tuple[Features, np.ndarray]:
        """Made once in each process that reads the broadcast, for all its tasks."""
        if self.held is None:
            w = np.zeros(self.cells)
            w[self.at] = self.kept
            self.held = Features(self.channel, int(self.cells).bit_length() - 1), w
        return self.held

    def score(self, features: Features, weights: np.ndarray, column: pa.Array) -> np.ndarray:
        if self.coef is None:
            return np.full(len(column), self.base)
        out = np.zeros(len(column))
        for first, end, row, cell in features.cells(column):
            x = summary(weights, row, cell, end - first)
            out[first:end] = 1 / (1 + np.exp(-np.clip(self.coef[0] + x @ self.coef[1:], -30, 30)))
        return out


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, bits: int = CELL_BITS) -> Scorer:
    """docs: every text, for the character model. labelled: (id, label) of the rows to learn from."""
    spark = docs.sparkSession
    _, tables = language_tables(count_grams(docs.select(text, F.lit("all").alias("grp")), text, "grp", 3), 3)
    channel = Model(["all"], tables, 3)
    some = labelled.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y"))
    some = some.orderBy(F.xxhash64(id_col, F.lit(10)), id_col).limit(rows)  # so many ids at most
    train = docs.select(id_col, text).join(F.broadcast(some), id_col).select(text, "y", (F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(2))).cast("int").alias("fold"))
    shared, cells = spark.sparkContext.broadcast(channel), 1 << bits

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Channel(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t and c.restore(t) for t in b.column(0).to_pylist()], pa.string()), b.column(1), b.column(2)], b.schema.names)

    train = materialize(train.mapInArrow(clear, train.schema), "toxicity-train")  # decoded once, read twice

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(None, bits)
        held: dict[int, list[np.ndarray]] = {}
        size = np.zeros(4, np.int64)
        for b in batches:
            group = 2 * b.column(2).to_numpy().astype(np.int64) + (b.column(1).to_numpy() == 1)
            size += np.bincount(group, minlength=4)
            for first, _, row, cell in f.cells(b.column(0)):
                pair = np.unique(row.astype(np.int64) << 32 | cell)
                g = group[first + (pair >> 32)]
                for k in range(4):
                    held.setdefault(k, []).append((pair & 0xFFFFFFFF)[g == k])
        for k, parts in held.items():
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            u, n = np.append(u, -1), np.append(n, size[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k)), pa.array(u), pa.array(n)], ["grp", "cell", "n"])

    t = train.mapInArrow(count, "grp long, cell long, n long").groupBy("grp", "cell").agg(F.sum("n").alias("n")).toArrow()
    grp, cell, n = (t.column(c).to_numpy().astype(np.int64) for c in ("grp", "cell", "n"))
    sizes, table = np.zeros(4, np.int64), np.zeros((4, cells), np.int32)
    for k in range(4):
        at = (grp == k) & (cell >= 0)
        table[k][cell[at]] = n[at]
        sizes[k] = n[(grp == k) & (cell < 0)].sum()
    clean, toxic = sizes[[0, 2]].sum(), sizes[[1, 3]].sum()
    base = float(toxic / max(1, clean + toxic))
    weights = log_odds(table[1] + table[3], table[0] + table[2], toxic, clean)
    if not clean or not toxic:
        return Scorer(channel, np.zeros(cells), None, base)
    # each half of the rows is summed up under the other half's statistics, as unseen rows are
    other = np.stack([log_odds(table[1 + 2 * (1 - k)], table[2 * (1 - k)], sizes[1 + 2 * (1 - k)], sizes[2 * (1 - k)]) for k in (0, 1)]).astype(np.float32)
    halves = spark.sparkContext.broadcast(other)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(None, bits)
        for b in batches:
            fold, x = b.column(2).to_numpy(), np.zeros((b.num_rows, 3))
            for first, end, row, cell in f.cells(b.column(0)):
                for k in (0, 1):
                    mine = fold[first:end] == k
                    x[first:end][mine] = summary(halves.value[k], row, cell, end - first)[mine]
            yield pa.RecordBatch.from_arrays([pa.array(b.column(1).to_numpy() == 1), *(pa.array(x[:, j]) for j in range(3))], ["y", "a", "b", "c"])

    m = train.mapInArrow(measure, "y boolean, a double, b double, c double").toArrow()
    x = np.column_stack([m.column(c).to_numpy() for c in "abc"])
    y = m.column("y").to_numpy().astype(float)
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], y))  # the fit doesn't depend on the order of tasks
    return Scorer(channel, weights, logistic(x[order], y[order]), base)


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """docs with score and predicted; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    shared, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        f, w = s.ready()
        for b in batches:
            p = s.score(f, w, b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(job, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
