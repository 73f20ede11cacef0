"""Chunkers against plain Python."""

import re

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.tokens import windows
from tessera.functions.vectors import hashing_embedder
from tessera.operators import chunking


def tokens(t):
    if not t:
        return 0
    n = len(t.split())
    guess = n * 1.33 if len(t) < 1000 else (n * 1.3 + len(t) / 4.0) / 2
    return max(1, n, min(int(guess), len(t) // 2))


def sentences(t):
    for a in tx.ABBREVIATIONS:
        t = t.replace(a, a.replace(".", "\x01"))
    return [s for s in (x.replace("\x01", ".").strip() for x in re.split(tx.SENTENCE_END, t)) if s]


def pack(parts, size):
    out, now, n = [], [], 0
    for p in parts:
        k = tokens(p)
        if n + k > size and now:
            out.append(" ".join(now))
            now, n = [], 0
        now.append(p)
        n += k
    return out + [" ".join(now)] * bool(now)


def fixed(t, size, least):
    runs, now = [], []
    for s in sentences(t):
        if tokens(s) > size:
            runs += pack(now, size)
            now = []
            runs += pack([p.strip() for p in re.split("[,;]", s) if p.strip()], size)
        else:
            now.append(s)
    runs += pack(now, size)
    made = [(i, re.sub(r"\s+", " ", x).strip()) for i, x in enumerate(runs)]
    return [(i, x, tokens(x)) for i, x in made if tokens(x) >= least]


def texts(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")


def test_fixed_chunks(spark, sf_small):
    docs = texts(spark, sf_small)
    for size, least in ((512, 100), (64, 10)):
        got = sorted((r["doc_id"], r["chunk_index"], r["text"], r["token_count"]) for r in chunking.fixed(docs, size, least).collect())
        assert got == sorted((r["doc_id"], *c) for r in docs.collect() for c in fixed(r["text"], size, least))


def test_abbreviations_and_long_sentences(spark):
    docs = spark.createDataFrame([(1, "Dr. Smith met Mr. Jones. They talked, e.g. About work. Fine!"), (2, ", ".join(["Word " * 40] * 6)), (3, ""), (4, None)], "doc_id long, text string")
    n = {r["doc_id"]: r["n"] for r in docs.select("doc_id", F.size(tx.sentences("text")).alias("n")).collect()}
    assert n == {1: 3, 2: 1, 3: 0, 4: 0}
    got = chunking.fixed(docs, 100, 0).where("doc_id = 2")
    assert got.count() == 6 and got.agg(F.max("token_count")).first()[0] <= 100
    assert chunking.fixed(docs, 100, 0).where("doc_id > 2").count() == 0


def test_overlap_and_its_removal(spark):
    chunks = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "c d e f"), (1, 2, "x y")], "doc_id long, chunk_index int, text string").withColumn("token_count", F.lit(5))
    got = [r["text"] for r in chunking.without_overlap(chunks).orderBy("chunk_index").collect()]
    assert got == ["a b c d", "e f", "x y"]
    lent = [r["text"] for r in chunking.with_overlap(chunks, 50).orderBy("chunk_index").collect()]
    assert lent[1] == "a b c d c d e f x y"
    shared = chunking.overlap_statistics(chunks).first()
    assert (shared["pairs"], shared["most_share"], shared["least_share"]) == (2, 50.0, 0.0)


def test_sections(spark):
    body = "intro words here\na) First Part\nsome text one two three\n●Detail: more\nline\n1. NUMBERED HEAD:\nlast"
    got = chunking.by_section(spark.createDataFrame([(1, body)], "doc_id long, text string"), 512, 0).orderBy("chunk_index").collect()
    assert [r["title"] for r in got] == [None, "a) First Part", "●Detail: more", "1. NUMBERED HEAD:"]
    kinds = [r["kind"] for r in chunking.section_headers(spark.createDataFrame([(1, body + "\nALL CAPITALS CATEGORY")], "doc_id long, text string")).orderBy("line").collect()]
    assert kinds == ["section", "subsection", "section", "category"]


def test_hierarchy_numbers_children_through_the_document(spark, sf_small):
    made = chunking.hierarchical(texts(spark, sf_small), 256, 64, 0)
    kids = made.where("kind = 'child'")
    assert kids.select("doc_id", "chunk_index").distinct().count() == kids.count()
    assert chunking.expand_to_parent(made).where("parent_text IS NULL").count() == 0


def test_adaptive_takes_every_branch(spark, sf_small):
    made = chunking.adaptive(texts(spark, sf_small), hashing_embedder(), 300, 1500, min_tokens=0)
    assert {r["strategy"] for r in made.select("strategy").distinct().collect()} == {"fixed", "semantic", "hierarchical"}


def test_windows(spark):
    row = spark.range(1).select(windows(F.array(*map(F.lit, range(7))), 3, 1).alias("w")).first()
    assert row["w"] == [[0, 1, 2], [2, 3, 4], [4, 5, 6]]


def test_sentences_by_one_split_are_those_of_replaced_stops(spark):
    odd = ["See e.g. This. And i.e.g. That. The U.S. Army, the U.S.S. Enterprise. Mr. X met Dr.  Y.\n\nEtc. Ends etc. Here! Is it? Yes", "\x0b A. B. C \f", "Corp. Co. Ph.D. M.D. X.M.A. Is. Vs. vs. So. ", ""]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").select("doc_id", tx.sentences("text").alias("s"))
    assert {r["doc_id"]: r["s"] for r in rows.collect()} == {i: sentences(t) for i, t in enumerate(odd)}


def test_chunks_are_cleaned_as_by_plain_patterns(spark):
    odd = ["a  b\n\nc \t d\x0b", " [PAGE 3] x[HEADER]y [TABLE 12]\n[FOOTER] [NOTE] z ", "\n \n", "plain text"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").select("doc_id", chunking.clean_chunk(F.col("text")).alias("t"))
    plain = [re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"\[PAGE \d+\]|\[HEADER\]|\[FOOTER\]|\[TABLE \d+\]", "", t)).strip(" ") for t in odd]
    assert {r["doc_id"]: r["t"] for r in rows.collect()} == dict(enumerate(plain))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_cut_once_however_they_are_filtered(spark, sf_small):
    docs = texts(spark, sf_small)
    for made in (chunking.fixed(docs, 256, 50), chunking.with_parents(docs, 1024, 256, 50), chunking.semantic(docs, hashing_embedder(), 256, min_tokens=50)):
        filters = [x for x in planned(made).splitlines() if "Filter" in x]
        assert not any("regexp_replace" in x or "split" in x for x in filters)
    for made in (chunking.all_statistics(chunking.fixed(docs, 256, 0)), chunking.without_either(chunking.fixed(docs, 256, 0)), chunking.with_parents(docs, 1024, 256, 50)):
        assert planned(made).count("FileScan") == 1 and "Join" not in planned(made)


def test_one_pass_gives_what_two_gave(spark, sf_small):
    docs = texts(spark, sf_small)
    both = lambda a, b: sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
    made = chunking.fixed(docs, 64, 0)
    assert both(chunking.all_statistics(made), chunking.statistics(made).join(chunking.overlap_statistics(made), "doc_id", "left"))
    lent = chunking.with_overlap(made, 25)
    front, back = (f(lent).select("doc_id", "chunk_index", F.col("text").alias(n)) for f, n in ((chunking.without_overlap, "without_front"), (chunking.without_following, "without_back")))
    assert both(chunking.without_either(lent), front.join(back, ["doc_id", "chunk_index"]))
    assert both(chunking.with_parents(docs, 256, 64, 10), chunking.expand_to_parent(chunking.hierarchical(docs, 256, 64, 10)))
