"""The pipeline's stages one by one against plain Python, on the smallest table."""

from collections import defaultdict

import pytest

from tessera.llm import pii

from .fixtures import awkward, table
from .test_lines_and_quality import plain_measures
from .test_pairs import plain_components
from .test_tokens_and_models import plain_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(line):
    return line.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def kept_text(rows):
    holders = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r["doc_id"])
    return {r["doc_id"]: None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if len(holders[key(x)]) < 3 or r["doc_id"] == max(holders[key(x)])) for r in rows}


def test_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "jaccard_join", "pii", "packing"]

    good = stages["quality_rules"](spark, docs, sf_small)
    assert good.columns == COLUMNS
    rows = good.collect()
    passed = {r["doc_id"] for r in docs.collect() if not plain_measures(r["text"])[-1]}
    assert {r["doc_id"] for r in rows} <= passed and len(rows) >= 0.98 * len(passed)

    cut = stages["line_dedup"](spark, good, sf_small)
    assert cut.columns == COLUMNS and {r["doc_id"]: r["text"] for r in cut.collect()} == kept_text(rows)
    assert cut.where("n_chars <> length(text)").count() == 0

    single = stages["jaccard_join"](spark, cut, sf_small)
    assert single.columns == COLUMNS
    plain = plain_components([tuple(r) for r in cut.select(COLUMNS).collect()], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {d for d, n, c in plain if d == c or n == 0}

    clean = stages["pii"](spark, single, sf_small)
    assert clean.columns == COLUMNS and clean.count() == single.count()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        if not plain_spans(before[r["doc_id"]]) and not pii.candidates(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
        assert not plain_spans(r["text"])

    packed = stages["packing"](spark, clean, sf_small)
    assert packed.select("doc_id").distinct().count() == clean.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_awkward_documents_pass_through(spark):
    docs = table(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() > 0
    empty = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0 and len(awkward()) > 0
