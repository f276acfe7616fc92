"""Spelling variants: pairs of words one edit apart by pivotal grams, and the most frequent spelling each word leads to.

Words are counted in Spark. Every word of the vocabulary has its bigrams in one global order, rare ones first; its prefix is
the first three (and ties of the third), its pivots are two disjoint bigrams of the prefix of least total frequency, found by
dynamic programming. One edit leaves at least one pivot whole, so of two near words the one whose prefix ends earlier in
the order has a pivot in the other's prefix. The position limit is strict: a whole gram keeps its place from the start of the
word or from its end, and the text on that side of it is unchanged, as is one half of the other side. Pivots and prefix grams
therefore meet by equality on (gram, side, text on that side, that half), and the join verifies each pair by edit distance.

Cases: a null text has no runs; a null id is the empty string before the colon; an empty table gives an empty result; of near words
with equal counts the smaller in code-point order wins; a repeated row counts again; a run may be as long as the text;
other columns take no part.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termflow.session import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Planted slips: one run in so many, by hash, loses a code point.
SLIP = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Edits between near words, and the size of a gram.
EDITS, GRAM = 1, 2


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters after the planted slips, counted over all texts."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"({RUN})"))).alias("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.where(F.length("run") >= min_length).select(F.when(h % SLIP == 0, short).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Place of each bigram by (frequency, gram). Bigrams are bounded by the alphabet's square (about 90 letters)."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("g"))
    rows = grams.groupBy("g").agg(F.count("*").alias("n")).collect()
    return {g: i for i, (g, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def prefix_of(ranks: Sequence[int], edits: int = EDITS, gram: int = GRAM) -> list[int]:
    """Positions of the edits * gram + 1 rarest grams, with all ties of the last one."""
    order = sorted(range(len(ranks)), key=lambda i: (ranks[i], i))
    k = edits * gram + 1
    if len(order) > k:
        last = ranks[order[k - 1]]
        while k < len(order) and ranks[order[k]] == last:
            k += 1
    return order[:k]


def pivots_of(prefix: Sequence[int], weight: Sequence[int], edits: int = EDITS, gram: int = GRAM) -> list[int]:
    """Positions of edits + 1 disjoint grams of the prefix of least total weight.

    best[j] over the grams seen so far: least weight of j disjoint grams, either without the last gram, or with it after the
    grams that end before it.
    """
    at = sorted(prefix)
    count = edits + 1
    table: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * count]
    for i, p in enumerate(at):
        before = sum(q + gram <= p for q in at[:i])  # grams that end before p
        row = list(table[i])
        for j in range(1, count + 1):
            head = table[before][j - 1]
            if head is not None:
                new = (head[0] + weight[p], (*head[1], p))
                if row[j] is None or new < row[j]:
                    row[j] = new
        table.append(row)
    return list(table[-1][count][1]) if table[-1][count] else at


def limits(word: str, at: int) -> Iterator[tuple[bool, str]]:
    """(right, text) for every way in which one edit may leave the gram at `at` its place; two near words share one of them.

    The edit is on one side of the gram, so the text on the other side stays. The edited side (m code points in the shorter word)
    keeps either its m // 2 code points next to the gram or its last m // 2. A word is the shorter, the longer or as long, so it
    gives the limits for m and for m - 1.
    """
    for right in (False, True):
        same, other = (word[at + GRAM:], word[:at][::-1]) if right else (word[:at], word[at + GRAM:])  # other: from the gram outwards
        for half in {len(other) // 2, max(len(other) - 1, 0) // 2}:
            if half:
                yield right, f"{same} {other[:half]}"
                yield right, f"{same} {other[-half:]} "
            else:
                yield right, same


def keyed_grams(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Rows (pivot, gram, right, rest, word, last) of every pivot and prefix gram and position limit; last is the prefix's last rank."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = shared.value
        for b in batches:
            rows = []
            for w in b["word"]:
                r = [rank[w[i:i + GRAM]] for i in range(len(w) - GRAM + 1)]
                prefix = prefix_of(r)
                last = r[prefix[-1]]
                for pivot, places in ((False, prefix), (True, pivots_of(prefix, r))):
                    for p in places:
                        rows += [(pivot, r[p], right, rest, w, last) for right, rest in limits(w, p)]
            yield pd.DataFrame(rows, columns=["pivot", "gram", "right", "rest", "word", "last"])

    return words.select("word").mapInPandas(grams, "pivot boolean, gram int, right boolean, rest string, word string, last int")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): each unordered pair of words that one insertion, deletion or replacement of a code point turns into each other."""
    rows = materialize(keyed_grams(words, gram_ranks(words)), "spelling-grams")
    key = ["gram", "right", "rest"]
    piv = rows.where("pivot").select(*key, F.col("word").alias("a"), F.col("last").alias("a_last"))
    pre = rows.where("not pivot").select(*key, F.col("word").alias("b"), F.col("last").alias("b_last"))
    met = (F.col("p.gram") == F.col("x.gram")) & (F.col("p.right") == F.col("x.right")) & (F.col("p.rest") == F.col("x.rest"))
    near = (F.col("a_last") <= F.col("b_last")) & (F.abs(F.length("a") - F.length("b")) <= EDITS) & (F.col("a") != F.col("b"))
    hits = piv.alias("p").join(pre.alias("x"), met & near & (F.levenshtein("a", "b", EDITS) == EDITS))
    return hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = materialize(word_counts(docs, id_col, text), "spelling-words")
    pairs = materialize(near_pairs(words), "spelling-pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("o"))).alias("best"))
    out = words.join(best, "word", "left")
    led = -F.col("best.m") >= ratio * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best.o")).alias("form"), F.when(led, -F.col("best.m")).alias("form_n"))
    out = materialize(out, "spelling-forms")
    # counts grow by `ratio` with each step, so a path has at most log(largest count) steps; each round doubles what is known
    top = out.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(top, 2), ratio)))
    root = out.where("form is not null").select("word", F.col("form").alias("root"))
    for i in range(math.ceil(math.log2(steps)) + 1):
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        root = materialize(root.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"spelling-roots-{i}")
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
