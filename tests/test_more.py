import pytest
"""Replies, layout, exports and stored indexes."""

from pyspark.sql import functions as F

from tessera.functions import replies
from tessera.operators import exports, index, layout


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_replies(spark):
    nd = '{"message":{"content":"Hel"},"done":false}\nnot json\n{"message":{"content":"lo"},"done":true}\n{"message":{"content":"!"}}'
    assert one(spark, replies.from_ndjson(F.lit(nd))) == "Hello"
    sse = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"choices":[{"delta":{}}]}\ndata: {"choices":[{"delta":{"content":"b"}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"c"}}]}'
    assert one(spark, replies.from_events(F.lit(sse))) == "ab"


def test_layout(spark):
    rows = [(1, "WIDE", 0.9, 20.0, 0.0, 0.0, 40.0, 12.0), (1, "TITLE", 0.9, 70.0, 1.0, 48.0, 90.0, 12.0), (1, "one", 0.9, 20.0, 30.0, 0.0, 30.0, 12.0), (1, "cell", 0.9, 120.0, 31.0, 100.0, 140.0, 12.0),
            (1, "noise", 0.2, 20.0, 31.0, 0.0, 30.0, 12.0), (1, "end", 0.9, 20.0, 100.0, 0.0, 30.0, 12.0), (1, "7", 0.9, 20.0, 200.0, 0.0, 5.0, 12.0)]
    found = layout.lines(spark.createDataFrame(rows, "page_id int, text string, confidence double, cx double, cy double, x0 double, x1 double, height double"))
    assert [(r["text"], r["kind"]) for r in found.orderBy("line").collect()] == [("WIDE TITLE", "heading"), ("one | cell", "table"), ("end", "text"), ("7", "text")]
    assert layout.page_text(found).first()["text"] == "WIDE TITLE\none | cell\n\nend"
    assert one(spark, layout.bullet(F.lit(" 1. item"))) and not one(spark, layout.bullet(F.lit("item")))


def test_exports(spark, tmp_path):
    assert str(one(spark, exports.pdf_time(F.lit("D:20240102030405+01'00'")))) == "2024-01-02 03:04:05" and one(spark, exports.pdf_time(F.lit("D:x"))) is None
    assert one(spark, exports.first_filled(F.lit(" "), F.lit("b"))) == "b"
    m = spark.createDataFrame([("s", 0, "user", 'a "q", b'), ("s", 1, "assistant", "yes\nno"), ("t", 0, "user", "alone")], "session_id string, turn int, role string, text string")
    rows = exports.chat_rows(m)
    assert [tuple(r) for r in rows.collect()] == [("s", 0, 'a "q", b', "yes\nno", 6)]
    exports.write_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "c")).first()
    assert back["query"] == 'a "q", b' and back["response"] == "yes\nno"
    exports.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert exports.without_session(m, m.where("session_id = 's'").select("session_id").distinct()).count() == 1


def test_indexes(spark, tmp_path):
    k = index.KeywordIndex(spark, str(tmp_path / "k"))
    k.add(spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "doc_id long, text string"))
    q = spark.createDataFrame([(5, "blue"), (6, "green")], "query_id long, text string")
    assert [r["doc_id"] for r in k.search(q).collect()] == []  # in one of two documents: no weight
    k.add(spark.createDataFrame([(3, "green hill")], "doc_id long, text string"))
    assert {(r["query_id"], r["doc_id"]) for r in k.search(q).collect()} == {(5, 2), (6, 3)}
    assert k.statistics().first()["documents"] == 3
    v = index.VectorIndex(spark, str(tmp_path / "v"))
    v.add(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None)], "doc_id long, embedding array<float>"))
    hits = v.search(spark.createDataFrame([(9, [0.0, 0.9])], "query_id long, embedding array<float>"), 1).collect()
    assert [(r["doc_id"], r["rank"]) for r in hits] == [(1, 1)]


def test_encodings():
    from tessera.sources.files import decode_bytes, encoding_of

    for text, name in (("héllo", "utf-8"), ("héllo", "utf-8-sig"), ("héllo", "utf-16"), ("“quoted” – é", "windows-1252"), ("hé", "latin-1")):
        assert encoding_of(text.encode(name)) == name and decode_bytes(text.encode(name))[0] == text


def test_archives_of_other_formats_and_word_edges(spark):
    from tessera.sources import files

    files.register_archive(b"OWN!", lambda data: iter([("a.txt", data[4:]), (".DS_Store", b"x")]))
    found = spark.createDataFrame([("/a.own", "a.own", "archive", b"OWN!hello")], "path string, name string, kind string, content binary")
    assert [(r["marker"], r["text"]) for r in files.parsed(found).collect()] == [("[FILE: a.txt]", "hello")]
    files.ARCHIVES.clear()
    word = files._zipped({"word/document.xml": f'<w:document xmlns:w="{files._WORD[1:-1]}"><w:body><w:p><w:r><w:t>x</w:t></w:r></w:p></w:body></w:document>', "word/header1.xml": f'<w:hdr xmlns:w="{files._WORD[1:-1]}"><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>'})
    assert files.word_parts(word) == ["x"] and files.word_parts(word, edges=True) == ["x", "[HEADER]\ntop"]
    broken = spark.createDataFrame([("/b.docx", "b.docx", "docx", b"no zip"), ("/c.zip", "c.zip", "archive", b"no zip")], "path string, name string, kind string, content binary")
    assert all(r["error"] for r in files.properties(broken).collect()) and files.listed(broken).first()["error"]


def test_pages_sections_and_kinds(spark):
    from tessera.sources import files

    parts = spark.createDataFrame([("/p", 0, "[PAGE 1]", "x" * 90), ("/p", 1, "[PAGE 2]", ""), ("/w", 0, "", "intro"), ("/w", 1, "", "[HEADING 1] A"), ("/w", 2, "", "body"), ("/w", 3, "", "[TABLE 1]\na | b")], "path string, part int, marker string, text string")
    assert {r["path"]: r["pages"] for r in files.page_counts(parts).collect()} == {"/p": 2}
    assert {r["path"]: r["scanned"] for r in files.scanned(parts).collect()}["/p"]
    assert [r["text"] for r in files.section(parts.where("path = '/w'"), 1).orderBy("part").collect()] == ["[HEADING 1] A", "body", "[TABLE 1]\na | b"]
    assert files.paragraph_counts(parts.where("path = '/w'")).first()["paragraphs"] == 3
    known = {r["kind"]: (len(r["extensions"]), r["parsed"]) for r in files.kinds(spark).collect()}
    assert known["docx"] == (2, True) and known["image"][1] is False


def test_names_backups_and_stock_replies(spark, tmp_path):
    import re

    from pyspark.sql import functions as F
    from tessera.functions import checks
    from tessera.operators import chunking, generation, store

    row = spark.range(1).select(checks.unique_name(F.lit("a b?.tar.gz"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("n"), checks.media_type(F.lit("x.PDF")).alias("m"), chunking.clearly_structured(F.lit("docx"), F.lit(2), F.lit(None), F.lit(None)).alias("s"))
    assert re.fullmatch(r"a b_\.tar_20240102_030405_[0-9a-f]{8}\.gz", row.first()["n"]) and row.first()["m"] == "application/pdf" and row.first()["s"]
    kept = store.Backups(spark, str(tmp_path / "b"))
    assert kept.statistics().first()["versions"] == 0
    kept.create(spark.range(3))
    kept.create(spark.range(4))
    assert tuple(kept.statistics().first())[0] == 2 and kept.due(1000) and not kept.due(999)
    talk = spark.createDataFrame([(1, "hi", [("user", str(i)) for i in range(7)])], "query_id int, query string, history array<struct<role:string,text:string>>")
    said = generation.general_prompts(talk).first()
    assert said["user"].split("\n") == [*(f"user: {i}" for i in range(2, 7)), "user: hi"] and said["fallback"] in generation.GREETINGS
    s = spark.range(1).select(chunking.overlap_sentences(F.array(F.lit("one two three four."), F.lit("five six."), F.lit("seven.")), 4).alias("x")).first()["x"]
    assert s == ["five six.", "seven."]


def test_lists_find_most_neighbours_by_reading_some(spark, tmp_path):
    import numpy as np
    from tessera.operators import index, retrieval

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(30, 8))[rnd.integers(0, 30, 2000)] * 5 + rnd.normal(size=(2000, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(2000)], "doc_id long, embedding array<double>")
    asked = rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    kept = index.ListIndex(spark, str(tmp_path / "i"), probes=4)
    assert kept.build(rows, 24) == 24 and index.notes(spark, kept.path)["vectors"] == "2000"
    pairs = lambda hits: {(r["query_id"], r["doc_id"]) for r in hits.collect()}
    exact, found = pairs(retrieval.nearest(rows, asked, 10)), pairs(kept.search(asked, 10))
    assert len(exact & found) >= 0.9 * len(exact)
    assert kept.probe_more() == 8 and index.lists_for(99_999) == 1 and index.lists_for(390_000) == 4096 and index.lists_for(200_000) == 4096
    assert index.notes(spark, str(tmp_path / "none")) == {}
    none = index.ListIndex(spark, str(tmp_path / "e"))
    assert none.build(rows.limit(0)) == 1 and none.search(asked, 3).count() == 0


def test_vectors_of_several_lengths_and_odd_components(spark, tmp_path):
    from tessera.operators import retrieval

    rows = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 0.0]), (8, [1.0, 0.5, 2.0]), (9, [])]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    q = v.withColumnRenamed("doc_id", "query_id")
    found = {(r["query_id"], r["doc_id"]) for r in retrieval.nearest(v, q, 5).collect()}
    assert found == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (8, 8), (9, 9)}
    lists = index.ListIndex(spark, str(tmp_path / "lists"), probes=2)
    lists.build(v, 2)
    lists.add(spark.createDataFrame([(10, [0.5, 0.5]), (11, [0.5])], "doc_id long, embedding array<double>"))
    again = index.ListIndex(spark, str(tmp_path / "lists"), probes=2)
    assert {r["doc_id"] for r in again.search(q.where("query_id IN (1, 3, 4)"), 5).collect()} == {1, 2, 10}


def test_strategy_keeps_every_row(spark):
    from tessera.operators import chunking

    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "d " * 2000), (2, None), (3, "")], "doc_id long, text string")
    assert chunking.strategy(docs).count() == 5 and chunking.recommendations(docs).count() == 15


def test_a_failed_call_costs_its_own_row_alone(spark):
    from tessera.operators import generation

    def call(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    out = {r["user"]: (r["answer"], r["answer_error"]) for r in generation.answered(spark.createDataFrame([("a",), ("bad",), ("c",)], "user string").coalesce(1), call).collect()}
    assert out == {"a": ("A", None), "bad": (None, "ValueError: bad text"), "c": ("C", None)}
    short = generation.answered(spark.createDataFrame([("a",), ("b",)], "user string").coalesce(1), lambda x: x[:1]).collect()
    assert {r["answer"] for r in short} == {"a", "b"}


@pytest.mark.parametrize(("text", "name"), [
    ("Съешь же ещё этих мягких французских булок", "windows-1251"), ("Съешь же ещё этих мягких французских булок", "koi8-r"), ("да", "koi8-r"), ("Да", "windows-1251"),
    ("Zażółć gęślą jaźń, proszę", "windows-1250"), ("Fünf Wörter für größere Übungen", "latin-1"), ("naïve façade “déjà vu” — été", "windows-1252"), ("été éêè", "latin-1"),
    ("plain words without a mark", "utf-16-le"), ("plain words without a mark", "utf-16-be"), ("plain", "utf-8"), ("да", "utf-8"),
])
def test_encodings_by_pairs_of_bytes(text, name):
    from tessera.sources.files import decode_bytes

    assert decode_bytes(text.encode(name)) == (text, name)


def test_bytes_that_speak_for_nothing_fall_back():
    from tessera.sources.files import chance, encoding_of

    noise = bytes([0x80, 0x61, 0xA4, 0x62, 0xB6, 0x63]) * 5
    assert encoding_of(noise) == "windows-1252" and encoding_of(b"") == "utf-8" and chance(b"abc", "koi8-r") == 0


def test_boxes_are_neither_shuffled_nor_sorted_one_by_one(spark):
    box = lambda page, text, cy, cx, height=12.0, sure=0.9: (page, text, sure, cx, cy, cx - 5.0, cx + 5.0, height)
    rows = [box(1, "b", 12.0, 30.0), box(1, "a", 10.0, 12.0), box(1, "low", 11.0, 50.0, sure=0.5), box(1, "Tall Words", 60.0, 5.0, 30.0), box(1, "Words, not Tall", 90.0, 5.0), box(1, "LOUD 1!", 120.0, 5.0), box(1, "- x", 150.0, 5.0), box(2, "n", None, 5.0), box(2, "m", 3.0, 15.0), box(3, "none", 1.0, 1.0, sure=0.1)]
    boxes = spark.createDataFrame(rows, "page_id int, text string, confidence double, cx double, cy double, x0 double, x1 double, height double").repartition(3)
    found = layout.lines(boxes)
    assert sorted((r["page_id"], r["line"], r["text"], r["kind"], r["paragraph"]) for r in found.collect()) == [
        (1, 0, "a b", "text", 0), (1, 1, "Tall Words", "heading", 1), (1, 2, "Words, not Tall", "text", 1), (1, 3, "LOUD 1!", "heading", 1), (1, 4, "- x", "bullet", 1), (2, 0, "nm", "text", 0),
    ]
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and not any("cx" in x for x in windows)
