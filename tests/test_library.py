"""Functions, sources, store, generation and streams on hand-made rows."""

import html
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import checks, text, tokens, vectors
from tessera.operators import analytics, citations, context, generation, retrieval, store
from tessera.sources import files
from tessera.streaming import timings


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, text.clean("t"), t="<p>A &amp; B</p>  “q” \n\n\n\n ▪ x ") == 'A & B "q" \n\n • x'
    assert one(spark, text.clean("t", urls=True, emails=True), t="see http://a.b/c and a@b.co now") == "see and now"
    assert one(spark, text.nfc("t"), t="é") == "é"
    assert one(spark, text.html_unescaped("t"), t="&lt;&eacute;&#39;") == html.unescape("&lt;&eacute;&#39;")
    assert one(spark, text.without_boilerplate("t"), t="Page 1 of 2\nkeep\n12\nCopyright © me\nkeep too") == "keep\nkeep too"
    assert one(spark, text.marked_structure("t"), t="TITLE HERE\n- item\nplain") == "[HEADER] TITLE HERE\n[LIST] - item\nplain"
    assert one(spark, text.truncated("t", 12), t="hello wide world") == "hello..."
    assert one(spark, text.sections("t", 12), t="One two. Three four! Five") == ["One two", "Three four", "Five"]
    assert one(spark, text.duration(F.lit(90_000))) == "1.5m" and one(spark, text.file_size(F.lit(1536))) == "1.50 KB"


def test_checks(spark):
    assert one(spark, checks.valid_url("u"), u="https://a.b/c") and not one(spark, checks.valid_url("u"), u="ftp://a.b")
    assert one(spark, checks.valid_url("u", ["b.org"]), u="https://x.b.org/") and not one(spark, checks.valid_url("u", ["b.org"]), u="https://b.com/")
    assert not one(spark, checks.valid_url("u"), u="http://a b")
    assert one(spark, checks.valid_file("n", F.lit(10)), n="a.PDF") and not one(spark, checks.valid_file("n", F.lit(10)), n="../a.pdf")
    assert not one(spark, checks.valid_file("n", F.lit(0)), n="a.pdf") and not one(spark, checks.valid_file("n", F.lit(10)), n="a.exe")
    assert one(spark, checks.safe_name("n"), n="/x/y/ a:b?.txt ") == "a_b_.txt"
    assert one(spark, checks.document_id(F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit("x")).rlike(checks.LONG_DOCUMENT_ID))
    assert one(spark, checks.valid_vector(F.array(F.lit(0.0), F.lit(1.0)), 2)) and not one(spark, checks.valid_vector(F.array(F.lit(0.0)), 1))
    assert not one(spark, checks.valid_vector(F.lit(None).cast("array<float>"), 2))


def test_token_helpers(spark):
    assert one(spark, tokens.keep_words("t", 3, "middle"), t="a b c d e f") == "a [...] e f"
    assert one(spark, tokens.truncated("t", 5), t="some words that go on") == "some words that..."
    assert one(spark, tokens.chunk_tokens("t"), t="") == 0 and one(spark, tokens.chunk_tokens("t"), t="a") == 1


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, vectors.squared_distance(a, b)) == 5.0 and one(spark, vectors.cosine(a, b)) == 0.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0 and one(spark, vectors.similarity(F.lit(1.0))) == 0.5


def test_citations(spark):
    assert one(spark, citations.extracted(F.lit("x [2] [1] [2] [99999999999]"))) == [1, 2]
    assert one(spark, citations.renumbered(F.lit("x [3] [5] [9]"), F.lit(5))) == "x [1] [2] [9]"
    src = F.array(F.struct(F.lit("a.txt").alias("file_name"), F.lit(2).alias("page_number"), F.lit(None).cast("string").alias("section_title")))
    assert one(spark, citations.source_lines(src, True)) == "[1] a.txt (page 2)" and one(spark, citations.source_map(src))[1]["file_name"] == "a.txt"


def test_context(spark):
    rows = [("q", i, "One two. Three four. Five", 1.0 - i / 10, i + 1, 300) for i in range(5)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id int, text string, score double, rank int, tokens int")
    assert context.within_budget(df, 1000).count() == 2
    assert one(spark, context.sentence_prefix(F.lit("A b. C d. E"), F.lit(4), tokens.word_count)) == "A b. C d"
    got = context.within_budget(df.withColumn("tokens", F.lit(300)), 1150, tokens.word_count).where("partial").first()
    assert got["chunk_id"] == "2_partial" and got["score"] == pytest.approx(0.64)
    assert one(spark, context.distinct_sentences(F.lit("A. B. A"))) == "A. B"


def test_retrieval_edges(spark):
    hits = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.5, 2), (2, 10, 0.01, 1)], "query_id int, doc_id int, score double, rank int")
    assert {r["score"] for r in retrieval.normalised(hits).collect()} == {0.5}
    assert retrieval.above(hits, 0.4).count() == 3
    assert retrieval.fused([(hits, 1.0)], 1).count() == 2
    best = {r["query_id"]: r["score"] for r in retrieval.fused([(hits, 0.6), (hits, 0.4)], 1).collect()}
    assert best == {1: 1.0, 2: 1.0}
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple"), (3, None), (4, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "pear"), (8, "nothing"), (9, "")], "query_id int, text string")
    assert {r["query_id"] for r in retrieval.bm25(docs, asked, 5).collect()} == {7}
    assert retrieval.bm25(docs.limit(0), asked, 5).count() == 0


def test_generation(spark):
    assert one(spark, generation.query_class(F.lit('```json\n{"type": "general", "confidence": 1.7}\n```'))) == ("general", 1.0)
    assert one(spark, generation.query_class(F.lit("it looks general to me"))) == ("general", 0.6)
    assert one(spark, generation.prompt_type(F.lit("a specialist view"))) == "extraction"
    assert one(spark, generation.temperature(F.lit("compare a and b"), F.lit(""), F.lit("comparison"))) == 0.3
    assert one(spark, generation.confidence_temperature(F.lit(0.55), F.lit("x"))) == 0.4
    rows = spark.createDataFrame([("a",), ("b",)], "user string")
    assert [r["answer"] for r in generation.answered(rows, lambda x: [t.upper() for t in x]).orderBy("user").collect()] == ["A", "B"]
    assert all(r["answer"] is None for r in generation.answered(rows, lambda x: 1 / 0).collect())


def test_analytics(spark):
    none = F.lit(None).cast("double")
    assert one(spark, analytics.overall(F.lit(1.0), F.lit(1.0), F.lit(1.0), none, none)) == 1.0
    assert one(spark, analytics.score(F.lit("nan"))) == 0.0 and one(spark, analytics.score(F.lit("7"))) == 1.0
    u = spark.createDataFrame([("t", 0, 1, 4), ("t", 10, 2, 4)], "task_id string, s int, done int, total int").withColumn("ts", F.timestamp_seconds("s"))
    r = analytics.task_progress(u).first()
    assert (r["percent"], r["seconds_left"], r["status"]) == (50.0, 10.0, "running")


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id int, seq int, v string")
    new = spark.createDataFrame([(2, 1, "c"), (2, 2, "d"), (3, 1, "e")], "id int, seq int, v string")
    assert sorted((r["id"], r["v"]) for r in store.upsert(old, new, ["id"], "seq").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    b = store.Backups(spark, str(tmp_path / "b"))
    assert b.versions() == [] and b.create(old) == 1 and b.create(new) == 2
    assert b.same(1, old) and not b.same(1, new) and b.prune(1) == [1] and b.versions() == [2]
    cache = spark.createDataFrame([("a", 9)], "t string, value int").select(F.sha2("t", 256).alias("key"), "value")
    got = store.cached(spark.createDataFrame([("a",), ("bb",), ("bb",)], "text string"), cache, F.length)
    assert sorted((r["text"], r["value"]) for r in got.collect()) == [("a", 9), ("bb", 2), ("bb", 2)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("größe".encode("latin-1"))
    (tmp_path / "b.md").write_text("plain ☃")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x/one.txt", "first")
        z.writestr("__MACOSX/junk.txt", "no")
        z.writestr("two.txt", "second")
    with tarfile.open(tmp_path / "d.tgz", "w:gz") as t:
        info = tarfile.TarInfo("in.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    w = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:document>'
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", w)
    (tmp_path / "f.bin").write_bytes(b"\x00\x01\xff")
    found = files.files(spark, str(tmp_path))
    assert {r["name"]: r["kind"] for r in found.collect()} == {"a.txt": "txt", "b.md": "txt", "c.zip": "archive", "d.tgz": "archive", "e.docx": "docx", "f.bin": None}
    parts = files.parsed(found)
    docs = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.documents(parts).collect()}
    assert docs == {"a.txt": "größe", "b.md": "plain ☃", "c.zip": "[FILE: x/one.txt]\nfirst\n[FILE: two.txt]\nsecond", "d.tgz": "[FILE: in.txt]\ntar", "e.docx": "[HEADING 1] Top\nBody"}
    assert parts.where("error IS NOT NULL").count() == 1
    assert files.heading_sections(parts.where("path LIKE '%docx'")).first()["heading"] == "Top"
    with pytest.raises(ValueError):
        list(files.members("c.zip", (tmp_path / "c.zip").read_bytes(), most=1))


def test_streams(spark, sf_small, tmp_path):
    folder = str(tmp_path / "in")
    spark.read.parquet(f"{sf_small}/events.parquet").repartition(3).write.parquet(folder)
    batch = timings.windowed(spark.read.parquet(folder))
    assert batch.count() == 150
    stream = timings.run_complete(timings.windowed(timings.source(spark, folder, 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect()))
    once = timings.run_once(timings.distinct_events(timings.source(spark, folder, 1), ["event_id"], late="400 days"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert once.count() == 1000
    newest = timings.newest_per_key(timings.source(spark, folder, 1), 2)
    newest.writeStream.format("memory").queryName("newest").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select max(n) from newest").first()[0] == 2


def test_a_mean_that_is_whole_is_not_cut_below_by_the_order_of_its_sum(spark):
    held = (4.66, 2.46, 4.42, 1.54, 1.92)  # 15, but for the last digits of floating-point sums
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(held)], "who string, n int, duration_ms double").coalesce(1)
    rows = rows.withColumn("ts", F.timestamp_seconds("n"))
    assert analytics.performance(rows, "who").first()["mean_ms"] == 3


def test_sql_of_cleaned_pages_resolves_ampersands_without_a_semicolon(spark, tmp_path):
    import duckdb

    from tessera.plans import catalog

    pages = [(1, "a &amp; b &ampc &quot;d&quot; &amp;quot; &amp"), (2, "<p>x&amp;amp;y &ampamp;</p>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = dict(con.sql(catalog.ORACLES["cleaned_pages"]).fetchall())
    assert {r["page_id"]: r["text"] for r in catalog.cleaned_pages(spark, str(tmp_path)).collect()} == want


def test_a_long_run_of_accented_letters_does_not_make_a_text_cyrillic():
    shown = "Et treêaux pourenêaire aneau étreoi. Éré. Le pré où vêtu d'été il rêva. " + "éè" * 100 + "."
    assert files.encoding_of(shown.encode("latin-1")) == "latin-1"


def test_what_a_task_hands_on_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(files, "SLICE", 100)
    made = list(files.in_slices(((str(i), b"x" * 40) for i in range(10)), ["path", "content"]))
    assert [len(f) for f in made] == [3, 3, 3, 1] and [p for f in made for p in f["path"]] == [str(i) for i in range(10)]


def test_ids_of_a_batch_are_arrays_of_four_bytes_each():
    import pandas as pd

    from tessera.functions import bpe

    assert bpe.id_arrays(pd.Series(["two words", None])).map(lambda x: (x.dtype.str, len(x) > 0)).tolist() == [("<i4", True), ("<i4", False)]


def test_what_a_list_search_meets_in_one_task_is_bounded(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.operators import index, retrieval

    monkeypatch.setattr(retrieval, "BLOCK", 50)
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("embedding"))
    kept = index.ListIndex(spark, str(tmp_path / "v"), probes=2)
    kept.build(rows.where("doc_id < 100"), 2)
    kept.add(rows.where("doc_id >= 100"))  # a list grows after it was made
    asked = rows.withColumnRenamed("doc_id", "query_id")
    for side in kept._dealt(asked):
        assert side.groupBy("list", "part", "share").count().agg(F.max("count")).first()[0] < 100
    found = {(r["query_id"], r["doc_id"], r["rank"]) for r in kept.search(asked, 3).collect()}
    assert found == {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.nearest(rows, asked, 3).collect()}


def test_words_of_accented_letters_alone_do_not_make_a_text_cyrillic():
    for shown in ("Of erlysh er the esou atlyre.\nAionon on èê, le paeuxelle.", "De De una una " * 9 + "ñó " * 700 + "\nRaas, noosmios ciónes jagañ lañraraó asierr doas osar el doque.", "Ti wh, enndst onndble.\nDe anque re éè en auxrepa."):
        assert files.encoding_of(shown.encode("latin-1")) == "latin-1"
    for name in ("windows-1251", "koi8-r"):
        for shown in ("а.", "The word мир means peace, and world as well."):
            assert files.encoding_of(shown.encode(name)) == name


def test_windows_of_ids_are_many_and_join_to_the_text(spark):
    from unittest import mock

    from tessera.functions import bpe
    from tessera.plans import catalog

    texts = ["plain words again and again " * 30, "日本語の文字 🎉 ñandú éß " * 20, "🎉" * 9, "a", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size in (1, 2, 7, 100):
        cut = [r["w"] for r in rows.select("i", bpe.windows("text", size).alias("w")).orderBy("i").collect()]
        assert ["".join(w) for w in cut] == [t or "" for t in texts] and (size == 100 or all(len(w) > 1 for w in cut[:3]))
    lapped = [r["w"] for r in rows.select("i", bpe.windows("text", 20, 5).alias("w")).orderBy("i").collect()]
    ids = bpe._encoding(None)
    assert lapped[0][:2] == [ids.decode(ids.encode_ordinary(texts[0])[a : a + 20]) for a in (0, 15)] and lapped[0][-1] and texts[0].endswith(lapped[0][-1])
    for text, found in zip(texts[1:3], lapped[1:3], strict=True):
        assert all(w in text for w in found) and text.endswith(found[-1]) and len("".join(found)) > len(text)
    with mock.patch.object(catalog.bpe, "windows", wraps=bpe.windows) as asked:
        catalog.tokens_exact(spark, "/root/testdata/sf0.001")
    assert all(call.args[1] <= 512 for call in asked.call_args_list)
