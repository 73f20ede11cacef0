import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity

from .fixtures import awkward, rows_of, table

BAD = ["vile", "dreadful", "hateful", "rotten"]


def prose(rnd, n):
    return " ".join(f"{rnd.choice('bdfglmnprst')}{rnd.choice('aeiou')}{rnd.choice('bdfglmnprst')}{rnd.choice('aeiou')}" for _ in range(n))


def marked(n, seed=1):
    """(doc_id, text, ...) and (doc_id, toxic), where every fourth text has a bad word in each thirty."""
    rnd, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = prose(rnd, rnd.randrange(10, 400)).split()
        if toxic := i % 4 == 0:
            for at in range(0, len(words), 30):
                words[min(len(words) - 1, at + rnd.randrange(30))] = rnd.choice(BAD)
        rows.append((i, " ".join(words), "en", "s", len(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = marked(500)
    return toxicity.fit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), steps=250)


def test_gradients_are_those_of_the_loss():
    rnd = np.random.default_rng(0)
    net = toxicity.Network(["a", "b", "c"])
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    ids, runs = np.array([1, 2, 3, 0, 0]), toxicity.runs_of(["a", "b", "c", "dd", "eee"])
    at, mask = rnd.integers(0, 5, (6, 4)), np.arange(6)[:, None] < np.array([6, 6, 3, 1])
    at[:5, 0] = range(5)
    of = lambda: net.gradients(ids, runs, at, mask, np.array([1, 0, 1, 0.0]), np.array([1, 2, 1, 1.0]))
    grads = of()[1]
    for name, value in net.p.items():
        for _ in range(4):
            i = (int(rnd.choice(runs[0])), 1) if name == "char" else tuple(int(rnd.integers(0, n)) for n in value.shape)
            was = value[i]
            value[i] = was + 1e-5
            up = of()[0]
            value[i] = was - 1e-5
            down = of()[0]
            value[i] = was
            assert abs((up - down) / 2e-5 - grads[name][i]) < 1e-6, name


def test_windows_read_every_word():
    for n in (1, 5, 47, 48, 49, 83, 84, 85, 500):
        starts = toxicity.window_starts(n)
        assert {x for s in starts for x in range(s, min(n, s + toxicity.WINDOW))} == set(range(n)) and len(set(starts)) == len(starts)
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_held_out_texts_are_told_apart(spark, model):
    rows, labels = marked(400, seed=2)
    out = {r["doc_id"]: r for r in toxicity.score(table(spark, rows), None, model=model).collect()}
    toxic = {i for i, _, y in labels if y}
    assert {i: r["held_out"] for i, r in out.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in out}
    caught = {i for i, r in out.items() if r["predicted"]}
    assert len(caught & toxic) >= 0.95 * len(toxic) and len(caught - toxic) <= 0.03 * len(out)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out.values())


def test_the_last_words_of_a_very_long_text_count(spark, model):
    rnd = random.Random(5)
    clean = prose(rnd, 60_000)
    bad = f"{clean} {prose(rnd, 5)} vile {prose(rnd, 4)} dreadful rotten"
    out = {r["doc_id"]: r["score"] for r in toxicity.score(table(spark, [(1, clean, None, None, 1), (2, bad, None, None, 1)]), None, model=model).collect()}
    assert out[2] > max(0.7, out[1])


def test_a_score_does_not_depend_on_its_neighbours(model):
    rows, _ = marked(60, seed=3)
    texts = [t for _, t, *_ in rows] + ["", None, "x" * 5000, "one"]
    together = model.scores(toxicity.Scorer(model.network), texts)
    alone = np.array([model.scores(toxicity.Scorer(model.network), [t])[0] for t in texts])
    assert np.abs(together - alone).max() < 1e-4
    few = toxicity.Scorer(model.network)
    few.places([f"w{i}" for i in range(toxicity.REMEMBERED)])  # the memory starts over
    assert np.abs(model.scores(few, texts) - together).max() < 1e-4


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows_are_scored_each(spark, model, clashing):
    out = rows_of(toxicity.score(table(spark, clashing=clashing), None, model=model))
    assert sorted((r[0] for r in out), key=repr) == sorted((i for i, *_ in awkward()), key=repr)
    by = {}
    for i, _, score, _ in out:
        by.setdefault(i, set()).add(score)
    assert len(by[0] | by[1] | by[2]) == 1  # no words: null, empty, white space
    assert len(by[3] | by[4]) == 1  # the same text


def test_little_to_learn_from(spark):
    docs, none = table(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    toxic = spark.createDataFrame([*((i, 1, 1) for i in range(3, 12)), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxic).collect()} == {1.0}
    both = spark.createDataFrame([*((i, 1, int(i < 6)) for i in range(22)), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, both, model=toxicity.fit(docs, both, steps=3)).count() == len(awkward())
    assert toxicity.score(table(spark, []), both).count() == 0


def test_labels_held_out_are_not_learnt_from(spark):
    rows, labels = marked(90)
    mark = lambda ys: toxicity.fit(table(spark, rows), spark.createDataFrame(ys, "doc_id long, quality int, toxic int"), steps=5)
    one = mark(labels)
    two = mark([(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels])
    assert all((one.network.p[k] == two.network.p[k]).all() for k in one.network.p)
    assert table(spark, rows).select(toxicity.fold_of(F.col("doc_id"))).distinct().count() == 3
