from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import signature_join, suffix_dedup
from tessera.llm.components import components

from .fixtures import awkward, passage, rows_of, shingles, table, words


def plain_components(rows, width, num):
    sets = [shingles(t, width) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    by = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        by[root(i)].append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in by.items()}
    return sorted([(d, len(sets[i]), d if not sets[i] else least[root(i)]) for i, (d, *_) in enumerate(rows)], key=repr)


@pytest.mark.parametrize(("width", "num", "clashing"), [(3, 90, False), (5, 80, True)])
def test_awkward_documents(spark, width, num, clashing):
    out = signature_join.link(table(spark, clashing=clashing), width=width, num=num).select("doc_id", "n_shingles", "component_id")
    assert rows_of(out) == plain_components(awkward(), width, num)


def near_copies(seed, groups, size, edits):
    rnd = __import__("random").Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = passage(rnd, rnd.randrange(8, 160), 3000).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(0, edits + 1)):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(9999)}"
            rows.append((n, " ".join(w), "en", "s", 0))
            n += 1
    return rows


def test_links_of_near_copies_are_complete(spark):
    rows = near_copies(5, 30, 8, 3)
    out = signature_join.link(table(spark, rows), width=3, num=90).select("doc_id", "n_shingles", "component_id")
    assert rows_of(out) == plain_components(rows, 3, 90)


def test_large_clusters_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(signature_join, "BLOCK", 16)
    rows = near_copies(6, 2, 60, 4)
    out = signature_join.link(table(spark, rows), width=3, num=85).select("doc_id", "n_shingles", "component_id")
    assert rows_of(out) == plain_components(rows, 3, 85)


def test_large_clusters_that_share_much_go_in_rounds_and_move_texts(spark, monkeypatch):
    rounds, moved = [], []
    monkeypatch.setattr(signature_join, "BLOCK", 8)
    monkeypatch.setattr(signature_join, "ROUND", 0.5)
    monkeypatch.setattr(signature_join, "components", lambda edges: rounds.append(1) or components(edges))
    link = signature_join._link_clusters
    monkeypatch.setattr(signature_join, "_link_clusters", lambda blocked, *more: moved.append(blocked) or link(blocked, *more))
    rows = near_copies(7, 2, 60, 12)
    out = signature_join.link(table(spark, rows), width=3, num=85).select("doc_id", "n_shingles", "component_id")
    assert rows_of(out) == plain_components(rows, 3, 85)
    assert len(rounds) > 4  # clusters, blocks, neighbours, and more than one round
    # What moves is smaller than the sets, of eight bytes a shingle.
    assert moved[0].selectExpr("sum(length(text)) < 8 * sum(n)").first()[0]


def test_parts_of_linked_sets_meet():
    rnd = np.random.default_rng(3)
    for num in (80, 90):
        parts = signature_join.Parts(num, 100)
        for _ in range(300):
            s = int(rnd.integers(5, 400))
            a = np.unique(rnd.integers(0, 2**63, s).astype(np.uint64))
            b = np.unique(np.concatenate([a[int(rnd.integers(0, max(1, s // 8))) :], rnd.integers(0, 2**63, int(rnd.integers(0, max(1, s // 9)))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (len(a) + len(b) - both) and len(a) != both:
                assert set(parts.keys(a).tolist()) & set(parts.keys(b).tolist())


def test_tree_finds_what_all_pairs_find():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 2**63, 100).astype(np.uint64)
    sets = sorted((np.unique(np.concatenate([base[: int(rnd.integers(60, 100))], rnd.integers(0, 2**63, int(rnd.integers(0, 30))).astype(np.uint64)])) for _ in range(150)), key=len)
    found = signature_join.tree_links(sets, None, list(range(150)), 80, 100)
    up = list(range(150))

    def root(x, up):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in found:
        up[max(root(i, up), root(j, up))] = min(root(i, up), root(j, up))
    want = list(range(150))
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i, want), root(j, want)
                want[max(a, b)] = min(a, b)
    assert [root(i, up) == root(j, up) for i in range(150) for j in range(i)] == [root(i, want) == root(j, want) for i in range(150) for j in range(i)]


def test_keep_one(spark):
    docs = table(spark, clashing=True)
    out = signature_join.keep_one(docs, width=3, num=90)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got[3] == 1 and 4 not in got and got[12] == 0 and got[11] == 1 and got[0] == got[1] == got[2] == 1


def test_keep_one_keeps_a_row_of_every_component(spark):
    rnd = __import__("random").Random(21)
    texts = [passage(rnd, 40, 5000) for _ in range(5)]
    rows = [(i, t, "en", "s", 0) for i, t in zip((None, None, 7, 7, None, 9), [*texts, texts[4]], strict=True)]
    got = rows_of(signature_join.keep_one(table(spark, rows)).select("doc_id", "text"))
    assert got == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])], key=repr)


def test_empty_tables(spark):
    assert signature_join.link(table(spark, [])).count() == 0
    assert signature_join.keep_one(table(spark, [])).count() == 0
    assert suffix_dedup.repeats(table(spark, [])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}


def plain_cover(rows, n=50):
    at = defaultdict(list)
    for i, (_, t, *_) in enumerate(rows):
        w = words(t)
        for p in range(len(w) - n + 1):
            at[tuple(w[p : p + n])].append((i, p))
    cover = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for i, p in places:
                cover[rows[i][0]].update(range(p, p + n))
    return cover


@pytest.mark.parametrize("clashing", [False, True])
def test_repeated_passages(spark, clashing):
    got = defaultdict(set)
    for r in suffix_dedup.repeats(table(spark, clashing=clashing)).collect():
        assert r["end_word"] - r["start_word"] == r["n_words"] >= 50
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == dict(plain_cover(awkward()))


def test_planted_passages_over_many_ranges(spark):
    rnd = __import__("random").Random(9)
    shared = [passage(rnd, n, 5000) for n in (50, 51, 64, 90)]
    rows = [(i, f"{passage(rnd, 30, 5000)} {shared[i % 4]} {passage(rnd, 30, 5000)}", "en", "s", 0) for i in range(160)]
    rows += [(1000 + i, passage(rnd, 150, 5000), "en", "s", 0) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = suffix_dedup.repeats(table(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = defaultdict(set)
    for r in found:
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == dict(plain_cover(rows))
    assert not any(d >= 1000 for d in got)


def test_words_before_a_frequent_passage_that_pairs_share(spark):
    rnd = __import__("random").Random(13)
    shared = passage(rnd, 60, 5000)
    rows = []
    for i in range(200):
        own = passage(rnd, 30, 5000)
        rows += [(2 * i + k, f"{passage(rnd, 40, 5000)} {own} {shared} {passage(rnd, 40, 5000)}", "en", "s", 0) for k in range(2)]
    got = defaultdict(set)
    for r in suffix_dedup.repeats(table(spark, rows)).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == dict(plain_cover(rows))


def test_a_passage_that_ends_in_a_frequent_phrase(spark):
    rnd = __import__("random").Random(12)
    phrase = passage(rnd, 30, 5000)
    rows = [(1000 + i, f"{passage(rnd, 30, 5000)} {phrase} {passage(rnd, 60, 5000)}", "en", "s", 0) for i in range(300)]
    for i in range(20):
        own = passage(rnd, 20, 5000)
        rows += [(2 * i + k, f"{passage(rnd, 30, 5000)} {own} {phrase} {passage(rnd, 60, 5000)}", "en", "s", 0) for k in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = suffix_dedup.repeats(table(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = defaultdict(set)
    for r in found:
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        assert r["other_doc_id"] == r["doc_id"] ^ 1
    assert dict(got) == dict(plain_cover(rows)) and set(got) == set(range(40))
