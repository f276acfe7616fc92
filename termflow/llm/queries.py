"""The registered queries of the training-data operators, with the SQL that checks those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm import decontam, html_extract, langid, near_dup, packing, pii, pivot_search, resample, simhash, spelling, suffix_dedup, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.flag(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("bench_hits")).select("doc_id", "item_id", "distance", F.col("end").alias("match_end"))


def op2_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.train())


def op3_suffix_interval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: the sequence it is in and where."""
    return packing.pack(packing.items_of(table(spark, sf_dir, "documents"))).drop("cluster")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log-weight and whether it is in the sample of half the rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return resample.resample(docs.select("doc_id", "text"), labels.where("quality = 1"))


def op6_pivot_distance_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its values replaced, and how many of each kind were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs)
    return out.select("doc_id", "text", F.size("pii_spans").alias("n_values"), F.array_join(F.array_sort(F.array_distinct("pii_spans.kind")), ",").alias("kinds"))


def op8_weighted_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its class."""
    return near_dup.classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out("doc_id", 4, 2)
    model = langid.train(docs.where(~held))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = langid.held_out("doc_id", 5, 0)
    scorer = toxicity.fit(docs, labels.where(~held))
    return toxicity.score(docs.select("doc_id", "text"), scorer).select("doc_id", held.alias("held_out"), "score", "predicted")


def op11_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_tiled_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and the least id that links reach."""
    out = simhash.components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op13_pivotal_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_pigeonhole_decontamination": op1_pigeonhole_decontamination,
    "op2_crf_extraction": op2_crf_extraction,
    "op3_suffix_interval_dedup": op3_suffix_interval_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_pivot_distance_search": op6_pivot_distance_search,
    "op7_feistel_pseudonyms": op7_feistel_pseudonyms,
    "op8_weighted_minhash_classes": op8_weighted_minhash_classes,
    "op9_kneser_ney_language": op9_kneser_ney_language,
    "op10_noisy_channel_toxicity": op10_noisy_channel_toxicity,
    "op11_refined_whitening": op11_refined_whitening,
    "op12_tiled_simhash": op12_tiled_simhash,
    "op13_pivotal_spelling": op13_pivotal_spelling,
}

ORACLES: dict[str, str] = {
    "op6_pivot_distance_search": """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    # crc32 byte by byte over a table made by its rule; edit distance by brute force on one byte per letter
    "op13_pivotal_spelling": """
WITH RECURSIVE
runs AS (
  SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
kinds AS (SELECT row_number() OVER () AS k, id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY id, run),
texts AS (
  SELECT k, run, times, [ord(c) FOR c IN string_split(id || ':' || run, '')] AS cps FROM kinds),
bytes AS (
  SELECT k, run, times, flatten([CASE WHEN o < 128 THEN [o] ELSE [192 + (o >> 6), 128 + (o & 63)] END FOR o IN cps]) AS b FROM texts),
step(i, j, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, j + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM step WHERE j < 8),
tab AS (SELECT i, v FROM step WHERE j = 8),
crc(k, b, i, c) AS (
  SELECT k, b, 1, CAST(4294967295 AS BIGINT) FROM bytes
  UNION ALL
  SELECT k, b, crc.i + 1, xor(c >> 8, tab.v) FROM crc JOIN tab ON tab.i = (xor(c, CAST(b[crc.i] AS BIGINT)) & 255) WHERE crc.i <= len(b)),
slips AS (SELECT k, xor(c, 4294967295) AS h FROM crc WHERE i = len(b) + 1),
said AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times
  FROM bytes JOIN slips USING (k)),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
letters AS (SELECT string_agg(chr(CAST(192 + range AS INT)), '' ORDER BY range) AS l FROM range(64)),
plain AS (SELECT word, n, translate(word, l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~') AS p FROM words, letters),
pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM plain AS a JOIN plain AS b
  ON a.word <> b.word AND abs(length(a.p) - length(b.p)) <= 1 AND levenshtein(a.p, b.p) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
led AS (
  SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words AS w LEFT JOIN best USING (word)),
path(word, here) AS (
  SELECT word, word FROM led
  UNION ALL
  SELECT path.word, led.form FROM path JOIN led ON led.word = path.here WHERE led.form IS NOT NULL),
ends AS (SELECT path.word, path.here AS root FROM path JOIN led ON led.word = path.here WHERE led.form IS NULL)
SELECT led.word, form, root, n, n_near, form_n FROM led JOIN ends USING (word)""",
}
