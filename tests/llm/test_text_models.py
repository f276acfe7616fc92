"""Language identification, toxicity, resampling, html extraction: held-out accuracy, brute force and odd rows."""
import collections
import random
import itertools
import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termflow.llm import charlm, html_extract, langid, resample, textarr, toxicity

DOC = "doc_id long, text string, lang string, source string"


def odd_rows(spark):
    return spark.createDataFrame([(1, None, None, "a"), (2, "", "en", None), (3, "12 %% 34", "en", "a"), (4, "the cat and the dog " * 3000, "en", "a"), (5, "le chat et le chien", "fr", "a"), (5, "le chat et le chien", "fr", "a"), (None, "the dog", None, None)], DOC)


def test_words_and_shingles_match_python():
    texts = ["Eins zwei, drei", "", None, "a b c d e f", "é à ü " * 4]
    for _, _, data, off in textarr.blocks(pa.array(texts)):
        t = textarr.tokens(data, off)
        got = collections.defaultdict(list)
        for s, e, r in zip(t["start"], t["end"], t["row"], strict=True):
            got[int(r)].append(bytes(data[s:e]).decode())
        assert [got[i] for i in range(5)] == [["eins", "zwei", "drei"], [], [], list("abcdef"), ["é", "à", "ü"] * 4]
        h, row = textarr.shingles(t["hash"], t["row"], 5)
        assert [int((row == i).sum()) for i in range(5)] == [1, 0, 0, 2, 8]
        assert len(set(h[row == 4].tolist())) == 3  # the third repetition is the first again


def test_hash_index_finds_all():
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    index = textarr.HashIndex(h)
    assert (index.find(h) == np.arange(len(h))).all() and (index.find(h[1:] - np.uint64(1))[np.diff(h) > 1] == -1).all()


def brute_kneser_ney(texts, order):
    """Interpolated Kneser-Ney by definition, over strings."""
    counts = {order: collections.Counter()}
    for t in texts:
        for _, _, c, _ in charlm.folded([t], order):
            s = c.tolist()
            counts[order].update(tuple(s[i:i + order]) for i in range(len(s) - order + 1) if s[i + order - 1] != charlm.EDGE)
    for m in range(order - 1, 0, -1):
        counts[m] = collections.Counter(g[1:] for g in counts[m + 1])

    def p(g):
        m = len(g)
        if m == 0:
            return 1 / (max(2, len(counts[1])) + 1)
        c = counts[m]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))
        same = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        return max(c[g] - d, 0) / total + d * len(same) / total * p(g[1:])

    return p


def test_language_model_is_kneser_ney(spark):
    texts = ["the cat sat on the mat", "a cat and a hat", "that is the end"]
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], DOC)
    model = langid.train(docs)
    p = brute_kneser_ney(texts, 4)
    probe = "the hat zz is catty"
    (_, _, c, _), = charlm.folded([probe], 4)
    want = -sum(math.log(p(tuple(c[i:i + 4].tolist()))) for i in range(len(c) - 3) if c[i + 3] != charlm.EDGE)
    ce, _, n = model.entropies([probe])
    assert ce[0, 0] * n[0] == pytest.approx(want, rel=1e-4)


def test_model_keeps_every_gram_part_by_part(spark):
    texts = ["the cat sat on the mat", "a cat and a hat", "le chat et le chien sont la", "that is the end"]
    docs = spark.createDataFrame([(i, t, "fr" if "chat" in t else "en", None) for i, t in enumerate(texts)], DOC)
    counts = charlm.count_grams(docs, "text", "lang", 4)
    whole, parted = (langid.Model(*langid.language_tables(counts, 4, n), 4) for n in (1_000_000, 9))
    assert parted.files["gram", 4].values.n == counts.select("key").distinct().count() and parted.languages == ["en", "fr"]
    probe = [*texts, "the hat zz is catty", "", None, "zzz"]
    assert np.array_equal(whole.entropies(probe)[0], parted.entropies(probe)[0])


def test_rejection_thresholds_come_from_all_rows_by_language_and_length(spark):
    rows = [(i, f"the cat and the dog sat on the mat by the house {i % 7} " * (1 + i % 5), "en", None) for i in range(60)] + [(100, "kot i pies", "pl", None), (101, "ala ma kota a kot ma ale i psa oraz dom w lesie", "pl", None)]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.train(docs)
    assert model.threshold.shape == (2, len(langid.LENGTHS) + 1)
    ce, plain, size = model.entropies([r[1] for r in rows])
    best, length, gain = np.argmin(ce, axis=1), np.searchsorted(langid.LENGTHS, size, "right"), plain - ce.min(axis=1)
    for i, k in set(zip(best.tolist(), length.tolist(), strict=True)):
        own = np.sort(gain[(best == i) & (length == k)])
        assert model.threshold[i, k] == pytest.approx(min(own[0], langid.OF_MEDIAN * own[(len(own) - 1) // 2]), abs=1e-6)
    assert {(0, 2), (1, 0)} <= set(zip(best.tolist(), length.tolist(), strict=True))
    assert langid.identify(docs, model).where("not lang_accepted").count() == 0


def test_language_held_out_accuracy_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = langid.held_out("doc_id", 4, 2)
    model = langid.train(docs.where(~held))
    got = langid.identify(docs.where(held), model)
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()
    assert got.where("not lang_accepted").count() == 0
    odd = langid.identify(odd_rows(spark).withColumn("lang_pred", F.lit("x")), model).select("text", "lang_pred", "lang_score", "lang_accepted").collect()
    assert len(odd) == 7
    for r in odd:
        assert 0 <= r["lang_score"] <= 1
        if not charlm.has_letter(r["text"]):
            assert (r["lang_pred"], r["lang_score"], r["lang_accepted"]) == ("und", 0, False)
    nothing = langid.train(docs.where("1 = 0"))
    assert langid.identify(odd_rows(spark), nothing).where("lang_pred <> 'und'").count() == 0
    noise = spark.createDataFrame([(1, "xqzj wvkq zzxq kqjx vwxz qqkz jxqv zkwq " * 5, None, None)], DOC)
    assert not langid.identify(noise, model).first()["lang_accepted"]


def channel(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("grp", F.lit("all"))
    return langid.Model(*langid.language_tables(charlm.count_grams(df, "text", "grp", 3), 3), 3)


@pytest.fixture(scope="module")
def noisy(spark):
    words = "you are an idiot and a moron what a stupid loser this is trash and worthless pathetic clown here now imbecile troll dumbass scum"
    return toxicity.Channel(channel(spark, [words] * 3 + ["the house and the tree are in the garden of the other man, all well"] * 3))


@pytest.mark.parametrize("seen, meant", [
    ("an i d i o t here", "idiot"), ("m.o.r.o.n", "moron"), ("l0s3r", "loser"), ("tr@sh", "trash"), ("st*upid", "stupid"), ("cl0wwwwn", "clown"),
    ("dumba$$", "dumbass"), ("tro11", "troll"), ("imbecil3", "imbecile"), ('"1diot"', "idiot"), ("ssttuuppiidd", "stupid"), ("i  d  i  o  t", "idiot"),
    ("m\no\nr\no\nn", "moron"), ("m-o.r_o n", "moron"), ("st\u200bup\u200bid", "stupid"), ("id\u0456\u043et", "idiot"), ("($cum)", "scum"), ("iddiot", "idiot"),
])
def test_noisy_channel_restores_disguises(noisy, seen, meant):
    assert meant in noisy.restore(seen).split(), noisy.restore(seen)


def test_noisy_channel_leaves_plain_text(noisy):
    assert noisy.restore("the house and the tree") == "the house and the tree" and noisy.restore("all well") == "all well" and noisy.restore("") == ""
    assert noisy.restore("you stupid! what a loser.") == "you stupid! what a loser."


def test_single_pairs_are_decided_as_by_decoding(noisy):
    r = random.Random(7)
    seen = set()
    for _ in range(3000):
        w = "".join(r.choice("idotslernaf") for _ in range(r.randint(2, 9)))
        if sum(a == b for a, b in zip(w, w[1:], strict=False)) == 1:
            assert noisy._token(w) == noisy.decode(w)[1] and noisy._token(f'"{w}!') == f'"{noisy.decode(w)[1]}!'
            seen.add(noisy._token(w) == w)
    assert seen == {True, False}


@pytest.mark.parametrize("text", ["a b c d " * 40_000, "ab1" * 60_000, "oo" * 100_000, "a." * 100_000, "i  d\n" * 40_000])
def test_very_long_disguises_take_linear_time(noisy, text):
    t = time.time()
    noisy.restore(text)
    assert time.time() - t < 20


def test_decoding_is_the_best_of_all_paths(noisy):
    r = random.Random(6)
    for _ in range(250):
        text = "".join(r.choice("idotslern013@$!.* ") for _ in range(r.randint(1, 6)))
        best = None
        for path in itertools.product(*[noisy._readings(text, i) for i in range(len(text))]):
            state, score = charlm.EDGE << 16 | charlm.SPACE, 0.0
            for said, cost in path:
                score -= cost
                if said and not (said == " " and state & 0xFFFF == charlm.SPACE):
                    sym = int(noisy.fold[ord(said)])
                    score += noisy.logp(state << 16 | sym)
                    state = (state << 16 | sym) & 0xFFFFFFFF
            if state & 0xFFFF != charlm.SPACE:
                score += noisy.logp(state << 16 | charlm.SPACE)
            best = score if best is None else max(best, score)
        assert noisy.decode(text)[0] == pytest.approx(best)


def test_toxicity_held_out_and_odd_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scorer = toxicity.fit(docs, labels)
    got = toxicity.score(docs.select("doc_id", "text"), scorer).join(labels, "doc_id")
    assert got.where("predicted = 1 and toxic = 0").count() <= 2
    odd = toxicity.score(odd_rows(spark).withColumn("score", F.lit("x")), scorer).collect()
    assert len(odd) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)
    none = toxicity.fit(docs.where("1 = 0"), labels.where("1 = 0"))
    assert {r["score"] for r in toxicity.score(odd_rows(spark), none).collect()} == {0.0}


def test_toxicity_catches_disguised_words(spark):
    clean = [f"the {a} and the {b} are in the garden of {a}{b}" for a in ("tree", "house", "river", "stone", "cloud", "field") for b in ("bird", "flower", "road", "child", "horse", "light")]
    toxic = [c + " you idiot" for c in clean[:18]]
    docs = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= len(clean)).cast("int").alias("toxic"))
    scorer = toxicity.fit(docs, labels)
    probe = spark.createDataFrame([(1, "the tree and you 1d1ot"), (2, "the tree and you i d i o t"), (3, "the tree and the road")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score(probe, scorer).orderBy("doc_id").collect()] == [1, 1, 0]


def brute_log_weights(texts, good, cells):
    """Word and pair features by a dictionary of the same cells."""
    raw, target, per = np.zeros(cells), np.zeros(cells), []
    for t, g in zip(texts, good, strict=True):
        n = np.zeros(cells)
        for _, _, data, off in textarr.blocks(pa.array([t], pa.string())):
            toks = textarr.tokens(data, off, punctuation=True)["hash"]
            for h in toks.tolist():
                n[h & (cells - 1)] += 1
            for a, b in zip(toks.tolist(), toks.tolist()[1:], strict=False):
                n[int(textarr.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) & (2 ** 64 - 1)], np.uint64))[0]) & (cells - 1)] += 1
        per.append(n)
        raw += n
        target += n * g
    ratio = np.log((target + 1) / (target.sum() + cells)) - np.log((raw + 1) / (raw.sum() + cells))
    return [float((n * ratio).sum()) for n in per]


def test_resampling_matches_brute_force(spark):
    texts = ["good text, good words!", "bad ### junk", None, "", "good text again", "bad ### junk", "mixed good ### text"]
    good = [1, 0, 0, 0, 1, 0, 0]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, log_weight string")
    out = resample.resample(docs, docs.where("doc_id in (0, 4)").select("doc_id"), keep=0.5).orderBy("doc_id").collect()
    assert [r["log_weight"] for r in out] == pytest.approx(brute_log_weights(texts, good, resample.CELLS), abs=1e-9)
    chosen = sorted(out, key=lambda r: (-r["gumbel_key"], r["doc_id"]))[:round(0.5 * 7)]
    assert {r["doc_id"] for r in out if r["selected"]} == {r["doc_id"] for r in chosen}
    assert resample.resample(docs.where("1 = 0"), docs.where("1 = 0").select("doc_id")).count() == 0
    assert {r["log_weight"] for r in resample.resample(docs, docs.where("1 = 0").select("doc_id")).collect()} == {0.0}


def test_top_k_closes_in_on_ties(spark):
    df = spark.range(5000).withColumn("key", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 7.0))
    for k in (0, 1, 777, 4000, 5000, 9000):
        got = {r[0] for r in resample.top_k(df, "key", "id", k, cells=16, alone=50).where("selected").select("id").collect()}
        assert got == {r[0] for r in df.orderBy(F.desc("key"), "id").limit(k).select("id").collect()}


def test_extraction_of_unseen_pages():
    model = html_extract.train()
    right = sum(html_extract.main_text(p, model) == "\n".join(c) for p, c in html_extract.labelled_pages(40, seed=31))
    assert right >= 36


def test_extraction_from_broken_and_odd_pages(spark):
    page = "<html><head><title>x</title><script>if (a</p>b) {}</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><div class=ad>Buy now</div><article><h1>Big&nbsp;news &amp; more</h1><p>First  part.<br>\n still first, <i>all</i> of it. <p>Second part of the story, with words.</article><div class='comments'><div class='comment'><p>I like it. Very good.</p></div></div><footer>&copy; me</footer>"
    rows = [(1, "u", page, "c"), (2, None, None, None), (3, "u", "", "c"), (4, "u", "no markup, but a sentence.", "c"), (5, "u", "<article><p>" + "word " * 50000 + "end.", "c"), (1, "u", page, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df, html_extract.train()).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and by[1] == "Big news & more\nFirst part. still first, all of it.\nSecond part of the story, with words."
    assert by[2] == "" and by[3] == "" and len(by[5]) == 250004 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(df.where("1 = 0"), html_extract.train()).count() == 0


@pytest.fixture(scope="module")
def html_model():
    return html_extract.train()


@pytest.mark.parametrize("page, text", [
    ("<html><body><p class=x title=it's>One is here. And more.</p><p>I don't know. That is so.</p><p>Three. It isn't.</p></body></html>", "One is here. And more.\nI don't know. That is so.\nThree. It isn't."),
    ("<html><body><p>Only one paragraph of prose here. It has two sentences.</p></body></html>", "Only one paragraph of prose here. It has two sentences."),
    ("<body><div>Only one div of prose here. It has two sentences.</div></body>", "Only one div of prose here. It has two sentences."),
    ("Just a text without markup. It goes on.", "Just a text without markup. It goes on."),
    ("<p data-x='a > b' class=y>If 1 < 2 and 3 > 2, all is well. So it is.</p>", "If 1 < 2 and 3 > 2, all is well. So it is."),
    ("<p title=\"open>Lost quote here. The text goes on.</p>", "Lost quote here. The text goes on."),
    ("<p style='display:none'>Not this one. Never.</p><p data-style='display:none'>But this one. Always so.</p>", "But this one. Always so."),
])
def test_extraction_keeps_text_of_odd_markup(html_model, page, text):
    assert html_extract.main_text(page, html_model) == text


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 50_000 + "x", "<div>word one." * 50_000, '<a b=">" ' * 100_000, '<a b="' * 100_000, "<head>" * 100_000, "<!--" * 100_000, "<" * 300_000, "</x" * 200_000, "<ul><li>x" * 30_000])
def test_hostile_markup_is_read_in_linear_time(page):
    t = time.time()
    html_extract.blocks_of(page)
    assert time.time() - t < 5


def test_viterbi_equals_enumeration():
    g = np.random.default_rng(5)
    for n in range(1, 8):
        crf = html_extract.Crf()
        crf.index = {f"f{i}": i for i in range(6)}
        crf.w, crf.pair, crf.first = g.normal(size=(6, 2)), g.normal(size=(2, 2)), g.normal(size=2)
        fs = [[f"f{j}" for j in range(6) if g.random() < 0.5] + ["unknown"] for _ in range(n)]
        s = [sum((crf.w[crf.index[x]] for x in f if x in crf.index), np.zeros(2)) for f in fs]
        value = lambda y: crf.first[y[0]] + sum(s[i][y[i]] for i in range(n)) + sum(crf.pair[a][b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert tuple(crf.decode(fs)) == max(np.ndindex(*[2] * n), key=value)


def test_crf_marginals_agree_with_enumeration():
    crf = html_extract.Crf()
    g = np.random.default_rng(3)
    crf.pair, crf.first, s = g.normal(size=(2, 2)), g.normal(size=2), g.normal(size=(5, 2))
    total, one = 0.0, np.zeros((5, 2))
    for y in np.ndindex(*[2] * 5):
        w = math.exp(crf.first[y[0]] + sum(s[i][y[i]] for i in range(5)) + sum(crf.pair[a][b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        for i in range(5):
            one[i][y[i]] += w
    got, _, z = crf._expect(s)
    assert np.allclose(got, one / total) and z == pytest.approx(math.log(total))
