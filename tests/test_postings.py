import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, postings, retrieval


def texts(n, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(["common"] * rnd.randrange(1, 3) + [f"w{int(rnd.expovariate(0.02))}" for _ in range(rnd.choice([3, 8, 30, 120]))])) for i in range(n)] + [(n, ""), (n + 1, None)]


def brute(docs, queries, k):
    terms = lambda t: [w for w in (re.sub(r"[\W_]", "", x) for x in (t or "").lower().split()) if 2 <= len(w) <= 50]
    own = {i: Counter(terms(t)) for i, t in docs}
    n, mean = len(own), sum(c.total() for c in own.values()) / max(1, len([t for _, t in docs if t is not None]))
    df = Counter(t for c in own.values() for t in c)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = sum(raw.values()) / len(raw) * 0.25
    out = set()
    for q, text in queries:
        scores = []
        for i, c in own.items():
            s = sum((raw[t] if raw[t] >= 0 else low) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for t in terms(text) if t in c)
            scores.append((-round(s, 9), i))
        out |= {(q, i, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1) if s < 0}
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 40)
    monkeypatch.setattr(postings, "QUERY_BLOCK", 7)


def frame(spark, rows, name="doc_id"):
    return spark.createDataFrame(rows, f"{name} long, text string").repartition(3)


def test_top_k_equals_brute_force(spark, small_blocks):
    docs, queries = texts(700), [(q, f"common w{q} w{3 * q} w{q} w999") for q in range(20)] + [(90, ""), (91, None), (92, "nothing known")]
    out = {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.bm25(frame(spark, docs), frame(spark, queries, "query_id"), 5).collect()}
    assert out == brute(docs, queries, 5)


def test_pairs_of_blocks_stay_far_below_matches(spark, small_blocks, tmp_path):
    docs, queries = texts(3000), [(q, f"common w{q} w{q + 1}") for q in range(25)]
    kept = index.KeywordIndex(spark, str(tmp_path / "k"))
    kept.add(frame(spark, docs))
    found, pairs = postings.best(kept.segments.read("blocks"), kept.terms(), frame(spark, queries, "query_id"), kept.sizes()[1], 5)
    n_blocks = kept.segments.read("blocks").select("block").distinct().count()
    n_pairs = pairs.count()
    assert n_pairs < 0.03 * 3000 * 25 and n_pairs < 0.9 * n_blocks * 25  # every document matches every query
    assert found.count() <= 5 * n_pairs
    out = {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.ranked(found, 5).collect()}
    assert out == brute(docs, queries, 5)


def test_segments_add_up_and_deletes_take_away(spark, small_blocks, tmp_path):
    docs, queries = texts(300), [(q, f"common w{q} w{2 * q}") for q in range(8)]
    kept = index.KeywordIndex(spark, str(tmp_path / "k"))
    for part in range(3):
        kept.add(frame(spark, [d for d in docs if d[0] % 3 == part]))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "k").rglob("part-*")}
    kept.add(frame(spark, [(1000 + i, t) for i, t in docs[:50]]))
    gone = [1000 + i for i, _ in docs[:50]] + [5, 6, 7, 424242]
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "doc_id long")
    kept.delete(ids(gone))
    kept.delete(ids(gone[:9]))  # gone already
    assert all(p.stat().st_mtime_ns == before[p.name] for p in (tmp_path / "k").rglob("part-*") if p.name in before)
    left = [d for d in docs if d[0] not in gone]
    anew = index.KeywordIndex(spark, str(tmp_path / "anew"))
    anew.add(frame(spark, left))
    for one in (kept, kept.compacted(str(tmp_path / "c"))):
        assert one.statistics().first() == anew.statistics().first()
        rows = lambda df: sorted((r["term"], r["df"], r["total_tf"], round(r["idf"], 9)) for r in df.collect())
        assert rows(one.terms()) == rows(anew.terms())
        out = {(r["query_id"], r["doc_id"], r["rank"]) for r in one.search(frame(spark, queries, "query_id"), 5).collect()}
        assert out == brute(left, queries, 5)
    kept.add(frame(spark, docs[:1]), "overwrite")
    assert kept.statistics().first()["documents"] == 1


def test_a_part_that_was_not_marked_does_not_count(spark, tmp_path):
    kept = index.KeywordIndex(spark, str(tmp_path / "k"))
    kept.add(frame(spark, texts(20)))
    frame(spark, [(1, "x")]).select(F.lit("zz").alias("term"), F.lit(1).cast("long").alias("df"), F.lit(1).cast("long").alias("total_tf")).write.parquet(str(tmp_path / "k/terms/segment=2"))
    assert kept.terms().where("term = 'zz'").count() == 0


def test_blocks_hold_bounded_terms_and_are_made_without_a_row_for_each_term(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_TERMS", 2000)
    own = spark.createDataFrame([(i, 100, [f"w{(i + j) % 150}" for j in range(100)]) for i in range(200)], "doc_id long, length int, terms array<string>")
    dealt = postings.blocked(own)
    assert dealt.groupBy("block").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] < 6000
    made = postings.in_blocks(dealt)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.agg(F.sum(F.size("docs"))).first()[0] == 200 * 100


def test_deleted_ids_come_once_a_block_and_not_with_each_term(spark, tmp_path):
    kept = index.KeywordIndex(spark, str(tmp_path / "k"))
    kept.add(spark.createDataFrame([(f"d{i}", f"common w{i}") for i in range(400)], "doc_id string, text string"))
    kept.delete(spark.createDataFrame([(f"d{i}",) for i in range(1, 200)], "doc_id string"))
    found = kept.search(frame(spark, [(1, "w0 w5")], "query_id"), 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, (block" not in plan
    assert [(r["doc_id"], r["rank"]) for r in found.collect()] == [("d0", 1)]


def test_marks_within_words_go_and_words_stay_apart(spark):
    from tessera.functions import text as tx

    row = spark.createDataFrame([("Don't-stop\t— a1_b2\nÉté, x  yy!",)], "t string").select(tx.bm25_terms("t").alias("w")).first()
    assert row["w"] == ["dontstop", "a1b2", "été", "yy"]


def test_texts_become_the_terms_that_spark_cuts_them_into(spark):
    from tessera.functions import text as tx

    odd = ["Don't-stop\t— a1_b2\nÉté, x  yy!", "ΟΔΟΣ ΣΟΦΟΣ.\x0bİstanbul ẞtraße\x1cnotaspace", "a\u00a0b\u2003c d\x85e", "x" * 51 + " " + "y" * 50 + " ٣٤ ½ ⅷ 漢字 e\u0301a", "  ", "", None, "dup dup Dup dup!"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    want = {(r["doc_id"], r["term"], r["tf"], r["length"]) for r in retrieval.postings(rows).collect()}
    made = postings.in_blocks(postings.blocked(rows.withColumn("length", F.octet_length("text"))))
    flat = made.select("term", "df", "total_tf", F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("p")).collect()
    assert {(r["p"]["docs"], r["term"], r["p"]["tfs"], r["p"]["lengths"]) for r in flat} == want
    assert {(r["term"], r["df"], r["total_tf"]) for r in postings.counts(made).collect()} == {(t, len(own := [x for x in want if x[1] == t]), sum(x[2] for x in own)) for _, t, _, _ in want}


def test_search_without_an_index_cuts_texts_in_their_blocks(spark):
    docs = frame(spark, texts(50))
    made = retrieval.in_blocks(retrieval.blocked(docs.withColumn("length", F.octet_length("text"))))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp_replace(" not in plan


def test_documents_that_cannot_come_up_are_not_finished():
    import numpy as np

    rnd = np.random.default_rng(3)
    n, k = 4000, 10
    sparse, whole = np.where(rnd.random(n) < 0.05, rnd.random(n) * 20, 0.0), rnd.random((6, n))
    rows, weights, stay = np.arange(6), np.array([0.5, 0.1, 0.4, 0.2, 0.3, 0.6]), rnd.random(n) < 0.9
    want = sparse + weights @ whole
    first = np.argsort(np.where(stay, -want, 0))[:k]
    for lowest in (0.0, want[first[-1]]):
        pick, total = postings.finished(sparse.copy(), whole, whole.max(axis=1), rows, weights, lowest, k, stay)
        assert len(pick) < n / 8 and set(first) <= set(pick) and np.allclose(total, want[pick])
    pick, total = postings.finished(sparse.copy(), whole, whole.max(axis=1), rows, -weights, 0.0, k, stay)
    assert len(pick) == n and np.allclose(total, sparse - weights @ whole)


def test_many_queries_are_scored_together(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(5)
    n, n_terms, n_queries = 900, 60, 41
    has = rnd.random((n_terms, n)) < rnd.choice([0.01, 0.2, 0.9], n_terms)[:, None]
    value = np.where(has, rnd.random((n_terms, n)), 0.0)
    weight = np.where(rnd.random((n_queries, n_terms)) < 0.3, rnd.random((n_queries, n_terms)) - 0.1, 0.0)
    term, at = np.nonzero(has)
    ends, (query, asked) = np.append(0, np.cumsum(has.sum(1))), np.nonzero(weight)
    for chunk, step in ((4_000_000, 100_000), (9 * n, 2 * n)):
        monkeypatch.setattr(postings, "CHUNK", chunk)
        monkeypatch.setattr(postings, "STEP", step)
        total = postings.totals(at, value[term, at], ends, n, query, asked, weight[query, asked], n_queries)
        assert np.allclose(total, weight @ value)
        least = np.where(np.arange(n_queries) % 2, 0.0, np.sort(total, axis=1)[:, -3])
        row, column, score = postings.chunk_best(total, least, 7)
        for q in range(n_queries):
            want = [d for d in np.lexsort((np.arange(n), -np.round(total[q], 9)))[:7] if total[q, d] > 0 and total[q, d] >= least[q] - 1e-9]
            assert column[row == q].tolist() == want
    # The same through Spark, several chunks a block.
    monkeypatch.setattr(postings, "CHUNK", 300)
    monkeypatch.setattr(postings, "BLOCK_DOCS", 40)
    docs, queries = texts(300), [(q, f"common w{q} w{3 * q} w{q} w999") for q in range(60)] + [(90, ""), (91, None)]
    out = {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.bm25(frame(spark, docs), frame(spark, queries, "query_id"), 5).collect()}
    assert out == brute(docs, queries, 5)


def test_packed_postings_hold_what_arrays_hold(spark, small_blocks):
    import numpy as np

    docs = frame(spark, texts(150)).withColumn("length", F.octet_length("text"))
    rows = lambda packed: postings.in_blocks(postings.blocked(docs), packed).collect()
    plain = {(r["block"], r["term"]): (r["docs"], r["tfs"], r["lengths"], r["df"]) for r in rows(False)}
    read = lambda x, kind: np.frombuffer(x, kind).tolist()
    assert plain == {(r["block"], r["term"]): (read(r["docs"], "i8"), read(r["tfs"], "i4"), read(r["lengths"], "i4"), r["df"]) for r in rows(True)}
    # Ids that are no longs stay what they are.
    named = docs.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")).alias("doc_id"), "text")
    asked = frame(spark, [(1, "common w3 w5"), (2, "")], "query_id")
    out = lambda d: sorted((r["query_id"], int(str(r["doc_id"]).lstrip("d")), r["rank"]) for r in retrieval.bm25(d, asked, 5).collect())
    assert out(named) == out(docs.select("doc_id", "text"))


def test_terms_move_as_one_string_and_pairs_meet_in_rounds(spark, tmp_path, monkeypatch):
    docs = [(i, f"word{i % 7} common " + " ".join(f"t{(i * j) % 31}" for j in range(i % 9))) for i in range(120)] + [(500, ""), (501, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    asked = rows.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text")
    shown = lambda found: sorted((r["query_id"], r["doc_id"], r["rank"], round(r["score"], 6)) for r in found.collect())
    want = shown(retrieval.bm25(rows, asked, 5))
    monkeypatch.setattr(postings, "PAIRS", 10)
    monkeypatch.setattr(postings, "BLOCK_DOCS", 8)
    rounds, pairs = [], postings.scored_pairs
    monkeypatch.setattr(postings, "scored_pairs", lambda *a: rounds.append(1) or pairs(*a))
    kept = index.KeywordIndex(spark, str(tmp_path / "i"))
    kept.add(rows.where("doc_id % 2 = 0"))
    kept.add(rows.where("doc_id % 2 = 1"))
    assert shown(kept.search(asked, 5)) == want and len(rounds) > 3  # the foremost blocks, then several rounds
    own = postings.in_blocks(spark.createDataFrame([("b", 1, ["x", "y", "x"]), ("b", 2, [])], "block string, doc_id long, terms array<string>"))
    assert sorted((r["term"], r["docs"], r["tfs"], r["lengths"]) for r in own.collect()) == [("x", [1], [2], [3]), ("y", [1], [1], [3])]
