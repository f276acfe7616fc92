"""Whitening, SimHash links, spelling variants: brute force and odd rows."""
import collections
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termflow.llm import simhash, spelling, whitening

DOC = "doc_id long, text string, id string, fp string, word string, n string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(None if t == "NOID" else first + i, t, "x", "y", "z", "w") for i, t in enumerate(texts)], DOC)


# whitening

def symmetric(values, seed):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d) - 0.5 * q.T @ q)
    return (q * np.array(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize("values", [
    list(range(1, 40)), [5.0] * 8, [0] * 6 + [1, 2, 3], [7.0], [0.0] * 4,
    [100 - 3 * i for i in range(10)] + [1 + 1e-7, 1 + 2e-7, 1 + 3e-7, 1.0], [1e4] * 3 + [1e4 + 1e-6] * 2 + [3, 2, 1e-3, 1e-3],
])
def test_refined_eigenvectors_leave_no_residual(values):
    a, q = symmetric(values, 1)
    e, x = whitening.eigen((a + a.T) / 2)
    top = max(map(abs, values)) or 1
    assert np.abs(e - np.sort(np.array(values, np.longdouble))[::-1]).max() <= 1e-17 * top
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(a @ x - x * e).max() < 2e-17 * top


def test_refinement_parts_close_eigenvalues_that_float32_cannot():
    values = [3, 2, 1 + 4e-9, 1 + 2e-9, 1.0]
    a, q = symmetric(values, 2)
    e, x = whitening.eigen((a + a.T) / 2)
    turned = np.abs(q.T @ x)
    assert np.abs(turned - np.eye(5)).max() < 1e-9  # error of order eps / gap; float32 alone gives any turn of the last three
    assert np.diff(np.asarray(e[2:], float)).max() < -1e-9


def brute_whitening(vectors):
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    cov = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3) for j in range(d)] for i in range(d)]
    y = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    return np.array([[float(c) for c in r] for r in cov]), dev, y


def test_whitening_equals_exact_fractions(spark):
    r = np.random.default_rng(3)
    good = (r.normal(size=(90, 7)) * np.array([3, 2.5, 2, 1, .5, .3, .2])).astype(np.float32).tolist()
    bad = [None, [], [1.0] * 6 + [None], [float("nan")] + [1.0] * 6, [float("inf")] + [1.0] * 6]
    rows = [(i, v, "c", 1) for i, v in enumerate(good)] + [(500 + i, v, "c", 2) for i, v in enumerate(bad)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n int").repartition(5)
    got = whitening.whiten(t, top=4).toPandas()
    cov, dev, y = brute_whitening(good)
    assert len(got) == 90 * 4 and set(got["n"]) == {90}
    assert got[got.component == 1].set_index("vec_id").deviation.reindex(range(90)).tolist() == dev
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(90)].to_numpy()
    want = y @ q[:, :4] / np.sqrt(e[:4])
    np.testing.assert_allclose(w * np.sign((w * want).sum(0)), want, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got.groupby("component").explained.first(), e[:4] / e.sum(), rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and {(x["deviation"], x["whitened"], x["explained"], x["identity_error"]) for x in one} == {(0, None, 0.0, 0.0)}
    short = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [-2.0])], schema)).toPandas()
    assert len(short) == 6 and short[short.component == 2].whitened.isna().all()
    np.testing.assert_allclose(sorted(short[short.component == 1].whitened.abs()), [0.5 ** 0.5] * 2 + [2 ** 0.5])
    far = whitening.whiten(spark.createDataFrame([(i, [s * 1e13, 0.25]) for i, s in enumerate((1, -1, 1))], schema)).toPandas()
    assert far.deviation.isna().any() and len(far) == 6


# SimHash

def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_bits():
    r = random.Random(5)
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É Ü à", "x y z w v\x85u", "a\x1cb c d"] + [" ".join(r.choice("ab cd ef GH ij") for _ in range(n)) for n in (3, 4, 50, 300)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    whole = simhash.fingerprint(texts[-1])
    simhash.CHUNK, kept = 7, simhash.CHUNK
    try:
        assert simhash.fingerprint(texts[-1]) == whole
    finally:
        simhash.CHUNK = kept


def classes_of(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("tile", [7, 4096])
def test_links_connect_what_brute_force_connects(spark, tile):
    r = random.Random(6)
    fps = [0, 1, (1 << 64) - 1, 1 << 63]
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.append(x)
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(nodes, tile=tile).collect()]
    assert all((a ^ b).bit_count() > 0 for a, b in edges) and edges
    place = {x: i for i, x in enumerate(fps)}
    want = classes_of(fps, 3)
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[place[a]], root[place[b]])
            changed |= root[place[a]] != m or root[place[b]] != m
            root[place[a]] = root[place[b]] = m
    assert len(set(zip(root, want))) == len(set(root)) == len(set(want))


def test_dense_group_gives_a_forest_not_all_pairs():
    base = np.uint64(0x0123456789ABCDEF)
    a = np.unique(np.array([base ^ np.uint64(1 << i) for i in range(64)], np.uint64))
    x, y = simhash.forest(a, a, 3)
    assert len(x) == 63 and set(y.tolist()) == {int(a.min())}


def test_components_and_odd_rows(spark):
    words = [f"w{i}" for i in range(400)]
    near = list(words)
    near[200] = "other"
    texts = [" ".join(words), " ".join(near), " ".join(words).upper(), None, "", "   ", "NOID", "NOID", " ".join(reversed(words)), "long " * 100_000]
    docs = frame(spark, texts, first=10)
    got = {(x["id"], x["fp"] % (1 << 64)): x["component"] for x in simhash.components(docs).collect()}
    fps = [brute_fingerprint(None if t is None else t) for t in texts]
    want = classes_of(fps, 3)
    ids = [None if t == "NOID" else 10 + i for i, t in enumerate(texts)]
    for i, fp in zip(ids, fps):
        members = [ids[k] for k in range(len(ids)) if want[k] == want[fps.index(fp)] and ids[k] is not None]
        assert got[i, fp] == min(members, default=None)
    assert got[11, fps[1]] == 10 and got[14, 0] == 13
    assert simhash.components(frame(spark, [])).count() == 0
    assert simhash.components(docs.union(docs)).count() == 20


# spelling

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def brute_variants(rows):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= 6
    words = {w: n for w, n in count.items() if n >= 5}
    out = {}
    for w, n in words.items():
        own = [x for x in words if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 5 * n else None, n, len(own))
    return out


def root_of(out, w):
    while out[w][0] is not None:
        w = out[w][0]
    return w


def test_pivots_are_disjoint_rare_and_least():
    r = random.Random(8)
    for _ in range(400):
        ranks = [r.randrange(9) for _ in range(r.randint(5, 14))]
        prefix = spelling.prefix_of(ranks)
        assert len(prefix) >= 3 and sorted(ranks[p] for p in prefix)[:3] == sorted(ranks)[:3]
        got = spelling.pivots_of(prefix, ranks)
        choices = [(ranks[a] + ranks[b], (a, b)) for a in prefix for b in prefix if b - a >= 2]
        assert tuple(got) == min(choices)[1]


def test_variants_match_brute_force(spark):
    r = random.Random(9)
    stems = ["".join(r.choice("abcdeéöß") for _ in range(r.randint(6, 9))) for _ in range(30)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa"]
    words = []
    for s in stems:
        w, n = s, r.choice((900, 150, 40, 8))
        while n >= 5:
            words += [w] * n
            i, c = r.randrange(len(w)), r.choice("abcdeéöß")
            w = r.choice((w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]))
            n //= r.choice((2, 5, 6))
    r.shuffle(words)
    texts = [" ".join(x.upper() if r.random() < .2 and x.isascii() else x for x in words[i:i + 60]) + r.choice(("!", "\n\n", "", " Ünder-score's 12")) for i in range(0, len(words), 60)]
    texts += [None, "", "1 2 3", "Zürich" * 3000, "ÀÉÎõü÷× " * 30]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "root", 7) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {x["word"]: x for x in spelling.variants(docs.repartition(4)).collect()}
    want = brute_variants(rows)
    assert set(got) == set(want) and len(want) > 60
    for w, (form, n, n_near) in want.items():
        assert (got[w]["form"], got[w]["n"], got[w]["n_near"], got[w]["form_n"], got[w]["root"]) == (form, n, n_near, form and want[form][1], root_of(want, w)), w
    assert any(root_of(want, w) != want[w][0] for w in want if want[w][0])  # a path of two steps at least


def test_near_words_share_a_position_limit_of_any_whole_gram():
    r = random.Random(10)
    for _ in range(3000):
        w = "".join(r.choice("ab") for _ in range(r.randint(6, 9)))
        i, c = r.randrange(len(w) + 1), r.choice("abc")
        x = r.choice((w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]))
        if len(x) < 6 or x == w:
            continue
        for p in range(len(w) - 1):  # grams that the edit leaves whole, and where they are then
            for q in {p} if p + 2 <= i else {p + len(x) - len(w)} if p > i or (p == i and len(x) > len(w)) else ():
                assert x[q:q + 2] == w[p:p + 2] and set(spelling.limits(w, p)) & set(spelling.limits(x, q))


def test_variants_of_empty_tables(spark):
    docs = frame(spark, [None, "", "short words only"])
    assert spelling.variants(docs).count() == 0
    assert spelling.variants(docs.limit(0)).count() == 0


def test_slips_follow_the_rule(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("Spelling").alias("text"))
    got = {x["word"]: x["n"] for x in spelling.word_counts(docs, min_count=1).collect()}
    want = collections.Counter()
    for i in range(400):
        h = zlib.crc32(f"{i}:spelling".encode())
        want["spelling" if h % 199 else "spelling"[:h % 8] + "spelling"[h % 8 + 1:]] += 1
    assert got == dict(want) and len(want) > 1
