"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is its bag of five-word shingles. A shingle's weight is its count in the text times a damped inverse document frequency:
1 + DAMP for shingles in fewer than COMMON of all documents (or in one), falling to 1 for one in every document. The document counts of the
common ones are exact: a first pass counts all shingles in a table of hash cells of fixed size, a second one counts in Spark those whose
cell reaches the bar, and only the common ones, so many at most as a text has shingles divided by COMMON, come to the driver. Weighted samples (Ioffe's scheme) are banded; texts that share a band's samples are compared by weighted Jaccard
similarity; links of 0.8 or more make the classes.

Within a band's bucket every text is compared with the bucket's first one. If the others are then not of one class, the texts
outside the largest class are indexed by shingle in blocks and all texts of the bucket run past the index. So no link between
candidates is lost, no pairs are listed, and buckets of copies cost one comparison a text.

Cases: equal texts are one class and enter once; a null text or one without a word is a class of its own; fewer than five words are one
shingle; the class id is the least id in the class; repeated rows have one class; an empty table gives an empty result; other columns take no part.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termflow.llm.graph import components
from termflow.llm.textarr import HashIndex, blocks, mix, shingles, tokens
from termflow.session import materialize

WORDS, SIMILARITY = 5, 0.8
#: 16 bands of 4 samples: a pair of similarity 0.8 is missed with probability 0.0002.
BANDS, ROWS = 16, 4
#: Share of the documents from which a shingle counts as common, and the weight that a rare one has over one in every document.
COMMON, DAMP = 0.002, 0.25
#: Pairs compared with one text in one task's group.
GROUP = 500
#: Texts in one index, and texts that run past it in one stream.
BLOCK, STREAM = 500, 2000
#: Cells of the first count, and shingles gathered before a task adds them up in the second.
CELL_BITS, CHUNK = 20, 2_000_000
_TABLE_BITS = 18
_LOW = np.uint64(0xFFFFFFFF)


class Sampler:
    """Consistent weighted samples; the random draws of (function, shingle) come from one table."""

    def __init__(self, seed: int = 8):
        g = np.random.default_rng(seed)
        n = 1 << _TABLE_BITS
        self.r, self.logc, self.beta = g.gamma(2.0, 1.0, n), np.log(g.gamma(2.0, 1.0, n)), g.random(n)
        self.plain = self.order(self.logc + self.r * self.beta - self.r)  # weight 1: t = 0
        self.mult = g.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = np.uint64(64 - _TABLE_BITS)

    @staticmethod
    def order(x: np.ndarray) -> np.ndarray:
        """Float32 bits in rising order, in the upper half of a word."""
        bits = x.astype(np.float32).view(np.uint32)
        return (bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))).astype(np.uint64) << np.uint64(32)

    def bands(self, h: np.ndarray, start: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One hash per row and band. Shingles of row i stand from start[i]; every row has one at least."""
        out = np.zeros((len(start), BANDS), np.uint64)
        odd = np.flatnonzero(weight != 1.0)
        logw, low = np.log(weight[odd]), h & _LOW
        for i in range(BANDS * ROWS):
            at = (h * self.mult[i]) >> self.shift
            key = self.plain[at] | low
            if len(odd):
                o = at[odd]
                t = np.floor(logw / self.r[o] + self.beta[o])
                a = self.logc[o] - self.r[o] * (t - self.beta[o] + 1.0)
                key[odd] = self.order(a) | ((low[odd] + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & _LOW)
            least = np.minimum.reduceat(key, start)
            out[:, i // ROWS] = mix(out[:, i // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(i))
        return out


def bags(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, row, shingle, count) per block: each text's different shingles in rising order."""
    for first, end, data, off in blocks(column):
        t = tokens(data, off)
        h, row = shingles(t["hash"], t["row"], WORDS)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        yield first, end, row[at], h[at], np.diff(np.append(at, len(h)))


def least_common(rows: int) -> float:
    """Documents from which a shingle counts as common; two at least."""
    return max(2.0, COMMON * rows)


class Weights:
    """TF-IDF weights; a rare shingle that stands once has weight 1."""

    def __init__(self, common: np.ndarray, df: np.ndarray, rows: int):
        self.index = HashIndex(common)
        idf = np.log(rows / np.maximum(df, 1)) / max(1e-9, np.log(max(rows, 1) / least_common(rows)))
        self.factor = np.append((1 + DAMP * np.clip(idf, 0, 1)) / (1 + DAMP), 1.0)

    def of(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        return count * (self.factor[self.index.find(h)] if len(self.index.hashes) else 1.0)


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    at = np.searchsorted(h1, h2)
    at[at == len(h1)] = 0
    same = h1[at] == h2
    both = np.minimum(w1[at[same]], w2[same]).sum()
    return float(both / (w1.sum() + w2.sum() - both))


def common_shingles(docs: DataFrame, text: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in COMMON or more of the rows, with their exact document counts.

    A cell's count is at least that of each of its shingles, so no common one is left out of the second count.
    """
    docs, bar = docs.select(text), least_common(rows)
    shift = np.uint64(64 - CELL_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for b in batches:
            for *_, h, _ in bags(b.column(0)):
                np.add.at(total, (h >> shift).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000]), pa.array(total[at[i:i + 100_000]])], ["cell", "n"])

    t = docs.mapInArrow(fill, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= bar).select("cell").toArrow()
    heavy = np.zeros(1 << CELL_BITS, bool)
    heavy[t.column("cell").to_numpy().astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(heavy))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, held, size = np.unpackbits(shared.value).astype(bool), [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i:i + 100_000].view(np.int64)), pa.array(c[i:i + 100_000])], ["h", "n"])

        for b in batches:
            for *_, h, _ in bags(b.column(0)):
                held.append(h[want[(h >> shift).astype(np.int64)]])
                size += len(held[-1])
                if size >= CHUNK:
                    yield from summed()
                    held, size = [], 0
        if held:
            yield from summed()

    t = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= bar).toArrow()
    h, n = t.column("h").to_numpy().astype(np.int64).view(np.uint64), t.column("n").to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def compare(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """(a, b, sim) of each pair. Pairs of one a are dealt out in groups of about GROUP, each with a's text once."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    t = texts.select(F.col("id"), "text")
    rows = heads.join(t, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = rows.union(dealt.join(t, F.col("b") == F.col("id")).select("a", "part", "b", "text"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(2)
            is_head, b = b.is_null().to_numpy(zero_copy_only=False), b.fill_null(-1).to_numpy()
            sim = np.zeros(batch.num_rows)
            for first, end, row, h, count in bags(batch.column(3)):
                w = shared.value.of(h, count)
                at = np.searchsorted(row, np.arange(end - first + 1))
                for i in range(first, end):
                    s = slice(at[i - first], at[i - first + 1])
                    if is_head[i]:
                        head = (h[s], w[s])
                    else:
                        sim[i] = weighted_jaccard(*head, h[s], w[s])
            keep = ~is_head
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(sim[keep])], ["a", "b", "sim"])

    return rows.mapInArrow(job, "a long, b long, sim double")


def across(inside: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """(a, b): links between texts of one bucket (band, key) that are not of one class (root), one at least for each text and other class.

    Only the texts outside a bucket's largest class are looked up: BLOCK of them form an index of shingles, and the bucket's texts
    run past it in streams of STREAM. No pair is a row; buckets of one class cost nothing.
    """
    sizes = inside.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band", "key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("others"), F.sum("n").alias("all")).where("others > 0")
    mixed = mixed.select("band", "key", "main", F.ceil(F.col("others") / BLOCK).alias("blocks"), F.ceil(F.col("all") / STREAM).alias("streams"))
    rows = materialize(inside.join(mixed, ["band", "key"]), "neardup-mixed")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = ["band", "key", "block", "stream"]
    index = rows.where("root <> main").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("stream", each("streams")).select(*place, F.lit(0).alias("kind"), "id", "root")
    run = rows.withColumn("stream", F.pmod(F.xxhash64("id"), F.col("streams"))).withColumn("block", each("blocks")).select(*place, F.lit(1).alias("kind"), "id", "root")
    dealt = index.unionByName(run).join(texts.select("id", "text"), "id").select(*place, "kind", "id", "root", "text")
    dealt = dealt.repartition(*place).sortWithinPartitions(*place, "kind")
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, table = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            kind, ids, roots = (batch.column(i).to_numpy() for i in (4, 5, 6))
            a, b = [], []
            for first, end, row, h, count in bags(batch.column(7)):
                w = shared.value.of(h, count)
                at = np.searchsorted(row, np.arange(end - first + 1))
                for i in range(first, end):
                    s = slice(at[i - first], at[i - first + 1])
                    if keys[i] != group:
                        group, held, table = keys[i], [], None
                    if kind[i] == 0:
                        held.append((ids[i], roots[i], h[s], w[s]))
                        continue
                    if table is None:
                        table = Lookup(held)
                    for x in table.links(ids[i], roots[i], h[s], w[s]):
                        a.append(min(x, int(ids[i])))
                        b.append(max(x, int(ids[i])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(job, "a long, b long").distinct()


class Lookup:
    """Index of the shingles of some texts (id, root, shingles, weights)."""

    def __init__(self, held: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.ids, self.roots = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        h, w = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        own = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        order = np.argsort(h, kind="stable")
        self.h, self.w, self.own = h[order], w[order], own[order]
        self.total = np.bincount(own, weights=w, minlength=len(held))
        self.done: set[tuple[int, int]] = set()

    def links(self, id_: int, root: int, h: np.ndarray, w: np.ndarray) -> list[int]:
        """Ids of the texts of other roots that are linked to this one; each text counts once for a root."""
        lo = np.searchsorted(self.h, h)
        n = np.searchsorted(self.h, h, "right") - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.own[at], weights=np.minimum(self.w[at], np.repeat(w, n)), minlength=len(self.ids))
        hit = np.flatnonzero((both >= SIMILARITY * (self.total + w.sum() - both)) & (self.roots != root))
        new = [int(self.ids[i]) for i in hit if (i, root) not in self.done]
        self.done.update((i, root) for i in hit)
        return new


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id): one row per different id."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    rows = base.count()
    weights = Weights(*common_shingles(base, "text", rows), rows)
    shared, sampler = spark.sparkContext.broadcast(weights), spark.sparkContext.broadcast(Sampler())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[np.ndarray] = [np.zeros(0, np.int64)] * b.num_rows
            for first, end, row, h, count in bags(b.column(2)):
                start = np.flatnonzero(np.diff(row, prepend=-1))
                if len(start):
                    for r, v in zip(row[start], sampler.value.bands(h, start, shared.value.of(h, count)), strict=True):
                        out[first + int(r)] = v.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["id", "th", "bands"])

    # a text without a word has no band and is its own class
    signed = base.select("id", F.coalesce(F.md5("text"), F.lit("")).alias("th"), "text").mapInArrow(sign, "id long, th string, bands array<long>")
    signed = materialize(signed.select("id", F.when(F.size("bands") > 0, F.col("th")).alias("th"), "bands"), "neardup-signatures")
    first = signed.where("th is not null").groupBy("th").agg(F.min("id").alias("rep"))
    alone = materialize(signed.select("id", "th").join(first, "th", "left").groupBy("id").agg(F.min(F.coalesce("rep", "id")).alias("rep")), "neardup-copies")

    keys = signed.join(first.select(F.col("rep").alias("id"), F.col("th").alias("own")), "id").where("th = own").dropDuplicates(["id"])
    keys = keys.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(keys.join(buckets, ["band", "key"]), "neardup-buckets")
    wanted = members.select("id").distinct()
    texts = materialize(base.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "neardup-texts")
    star = members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    star = materialize(compare(star, texts, weights), "neardup-star")
    links = star.where(F.col("sim") >= SIMILARITY).select("a", "b")
    comp = materialize(components(links), "neardup-star-classes")

    inside = members.where("id <> head").join(comp, "id", "left").select("band", "key", "id", F.coalesce("root", "id").alias("root"))
    more = materialize(across(inside, texts, weights), "neardup-across")
    if more.take(1):
        comp = materialize(components(links.unionByName(more)), "neardup-classes")
    out = alone.join(comp.select(F.col("id").alias("rep"), "root"), "rep", "left")
    return out.select("id", F.coalesce("root", "rep").alias("class_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose class has a smaller id; of rows with the same id one stays. Rows with a null id stay."""
    found = materialize(classes(docs, id_col, text).where("id <> class_id").select(F.col("id").alias(id_col)), "neardup-dropped")
    many = materialize(docs.groupBy(id_col).agg(F.count("*").alias("n")).where(f"n > 1 and {id_col} is not null").select(id_col), "neardup-repeated")
    kept = docs.join(found.hint("merge"), id_col, "left_anti")  # one plan at every size
    if not many.take(1):
        return kept
    return kept.join(many, id_col, "left_anti").unionByName(kept.join(many, id_col, "left_semi").dropDuplicates([id_col]))
