import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, whitening
from tessera.llm.tokens import Memo

from .fixtures import awkward, rows_of, table


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_singular_values_and_vectors(d):
    rnd = np.random.default_rng(d)
    for r in (rnd.normal(size=(d, d)), np.eye(d), np.diag(np.arange(1.0, d + 1)), np.zeros((d, d)), np.ones((d, d)), rnd.normal(size=(d, d)) * 10.0 ** -np.linspace(0, 12, d), np.diag(np.r_[np.ones(d - d // 2), 2 * np.ones(d // 2)]) @ np.linalg.qr(rnd.normal(size=(d, d)))[0]):
        squares, vectors = whitening.right_vectors(np.linalg.qr(r, mode="r"))
        want = np.linalg.svd(r, compute_uv=False) ** 2
        top = max(want[0], 1e-300)
        assert np.allclose(squares, want, atol=1e-13 * top) and np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-11
        assert np.abs(r.T @ (r @ vectors) - vectors * squares).max() < 1e-12 * top * d


def test_small_singular_values_are_accurate():
    a, b = 10.0 ** -np.arange(12.0), 10.0 ** -np.arange(1.0, 12) / 3
    exact = whitening.dqds(a, b)
    # The product of all is the determinant's square, in which a small absolute error would show.
    assert math.isclose(np.prod(exact), np.prod(a) ** 2, rel_tol=1e-12)


def vectors_of(spark, rows, clashing=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("v", "at", "w", "m", "n", "width", "component")}) if clashing else df


def brute(rows, width):
    x = [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    far = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    centred = np.array(far, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum(c * c for c in r) for r in far], centred, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("clashing", [False, True])
def test_whitening_equals_the_eigenvectors_of_the_covariance(spark, clashing):
    rnd = np.random.default_rng(4)
    mix = rnd.normal(size=(6, 6))
    good = [(i, np.float32(rnd.normal(size=6) @ mix).tolist()) for i in range(300)]
    good += [(5, good[5][1]), (None, good[6][1]), (301, good[7][1][:4]), (302, [])]
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan")]), (903, [float("inf")])]
    out = whitening.whiten(vectors_of(spark, good + bad, clashing), components=5).collect()
    n, deviation, centred, values, vectors = brute(good, 6)
    assert len(out) == 5 * len(good) and {r["n"] for r in out} == {n}
    assert Counter((r["vec_id"], r["deviation"]) for r in out) == Counter({k: 5 * c for k, c in Counter((i, d) for (i, _), d in zip(good, deviation, strict=True)).items()})
    for k in range(5):
        got = {(r["vec_id"], r["deviation"]): r["whitened"] for r in out if r["component"] == k + 1}
        want = {(i, d): w for (i, _), d, w in zip(good, deviation, centred @ vectors[:, k] / values[k] ** 0.5, strict=True)}
        sign = np.sign(got[good[0][0], deviation[0]] * want[good[0][0], deviation[0]])
        assert all(abs(got[x] - sign * want[x]) < 1e-9 for x in want)
        share = {r["explained"] for r in out if r["component"] == k + 1}
        assert len(share) == 1 and math.isclose(share.pop(), values[k] / values.sum(), rel_tol=1e-9)
    w = np.array([[r["whitened"] for r in sorted((r for r in out if r["component"] == k + 1), key=lambda r: (r["vec_id"] or -1, r["deviation"]))] for k in range(5)])
    assert abs(np.abs(np.cov(w, bias=True) - np.eye(5)).max() - out[0]["identity_error"]) < 1e-10 and out[0]["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])] * 4)).count() == 0  # no variance
    flat = whitening.whiten(vectors_of(spark, [(i, [float(i), 3.0, 2.0 * i]) for i in range(20)]))
    assert {r["component"] for r in flat.collect()} == {1} and flat.first()["explained"] == pytest.approx(1)
    huge = whitening.whiten(vectors_of(spark, [(i, [float(i) * 1e30, float(i % 3)]) for i in range(-9, 9)])).collect()
    assert len(huge) in (18, 36) and all(r["deviation"] is None for r in huge if r["vec_id"])


def test_triangles_merge_in_rounds(spark):
    rows = vectors_of(spark, [(i, np.float32(np.random.default_rng(i).normal(size=3)).tolist()) for i in range(400)])
    one, many = whitening.fit(rows.coalesce(1)), whitening.fit(rows.repartition(90, "vec_id"))
    assert one.sums == many.sums and np.allclose(one.variances, many.variances, rtol=1e-12)


def test_chunks_hold_every_word_once():
    rnd, code = random.Random(3), Memo(lambda w: hash(w) & 0xFFFFFF)
    for _ in range(300):
        words, width = [f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 60))], rnd.randint(1, 3)
        made = []
        for chunk, goes_on in collocations.chunks(words, width, code, 3):
            made += chunk[: len(chunk) - width] if goes_on else chunk
            assert chunk[-width:] == words[len(made) : len(made) + width] or not goes_on
        assert made == words


def mined(rows, longest, least, covered, top):
    by, n = {}, Counter()
    for _, text, lang, *_ in rows:
        text = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    by.setdefault(lang or "und", Counter())[tuple(words[at : at + size])] += 1
    out = []
    for lang, f in by.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and inside(p, q) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("longest", "least", "top", "clashing"), [(2, 2, 50, False), (3, 3, 2000, True), (4, 2, 400, False)])
def test_phrases_equal_brute_force(spark, longest, least, top, clashing):
    rnd = random.Random(8)
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in awkward() if len(t or "") < 9000]
    texts = [" ".join(rnd.choice(["new york", "New York city", "of the", "the", "à la", "É", "x.", "y,\tz", "a  b"]) for _ in range(rnd.randrange(80))) for _ in range(60)]
    rows += [(100 + i, t, rnd.choice(["en", "fr", None, "und"]), None, None) for i, t in enumerate(texts)]
    assert rows_of(collocations.mine(table(spark, rows, clashing), longest=longest, least=least, top=top, spread=4)) == mined(rows, longest, least, 50, top)


def test_phrases_of_little(spark):
    assert collocations.mine(table(spark, [])).count() == 0
    assert collocations.mine(table(spark, [(1, None, None, None, None), (2, "one two", "en", None, 7)])).count() == 0
