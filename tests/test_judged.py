import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import judged

SCHEMA = "id long, query string, answer string, contexts array<string>, truth string"


def embed(x):
    return F.array(F.length(x).cast("double"), F.lit(1.0))


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA).coalesce(1)


def yes(prompts):
    return [json.dumps({"questions": ["ab?"]} if json.loads(p)["task"] == "questions" else {"verdict": 1}) for p in prompts]


def test_replies_of_another_form_are_asked_for_again(spark):
    def call(prompts):
        call.seen += 1
        return ["no idea"] * len(prompts) if call.seen == 1 else ['```json\n{"verdict": 1}\n```' if "a" in p else '{"verdict": 2}' for p in prompts]

    call.seen = 0
    out = {r["prompt"]: r for r in judged.asked(spark.createDataFrame([("a",), ("b",), (None,)], "prompt string").coalesce(1), call, judged.verdict_of).collect()}
    assert (out["a"]["told"], out["a"]["tries"], out["a"]["error"]) == ("1", 2, None)
    assert (out["b"]["told"], out["b"]["tries"]) == (None, 3) and "verdict 2" in out["b"]["error"] and out[None]["tries"] == 0


@pytest.mark.parametrize("reply", ["", "{}", "[]", '{"verdict": true, }', '{"verdict": "1"}', '{"verdict": 0.5}', "verdict: 1", '{"questions": "x"}'])
def test_forms_are_strict(reply):
    for parse in (judged.verdict_of, judged.questions_of):
        with pytest.raises((ValueError, KeyError, TypeError)):
            parse(reply)


def test_calls_that_fail_leave_metrics_open(spark):
    def call(prompts):
        if any("useful" in p for p in prompts):
            raise ConnectionError("away")
        return yes(prompts)[:-1] if len(prompts) > 50 else yes(prompts)

    r = judged.evaluate(rows(spark, (1, "q", "One. Two.", ["c"], None)), call, embed).first()
    assert r["evaluated"] and r["context_relevancy"] is None and r["context_precision"] is None and r["context_recall"] is None


def test_metrics(spark):
    def call(prompts):
        out = []
        for p in map(json.loads, prompts):
            out.append(json.dumps({"questions": ["qq", "q"]} if p["task"] == "questions" else {"verdict": int(("good" in p["statement"]) if "statement" in p else ("use" in p["context"]))}))
        return out

    given = [(1, "q", "A good one. Bad one. Another good.", ["none", "use", "use"], "Good it is not. It is good."), (2, "q", "x", [], None), (3, " ", "x", ["c"], None), (4, "q", "A good one", ["none"], None), (5, "q", None, None, None)]
    out = {r["id"]: r for r in judged.evaluate(rows(spark, *given), call, embed).collect()}
    one = out[1]
    assert (one["faithfulness"], one["context_recall"], one["context_relevancy"]) == (round(2 / 3, 6), 0.5, round(2 / 3, 6))
    assert one["context_precision"] == round((1 / 2 + 2 / 3) / 2, 6) and 0.9 < one["answer_relevancy"] <= 1
    assert (out[2]["evaluated"], out[2]["reason"], out[2]["overall"]) == (False, "Not a RAG response", None)
    assert out[3]["reason"] == "Missing query or answer" and out[5]["reason"] == "Not a RAG response"
    assert out[4]["context_precision"] == 0 and out[4]["faithfulness"] == 1


def test_vectors_are_made_once_for_a_cosine(spark):
    rows = spark.createDataFrame([(1, "a b", "A b. C d.", ["a b"], "a")], "id long, query string, answer string, contexts array<string>, truth string")
    embed = lambda c: F.array(F.length(F.replace(c, F.lit("marked"))).cast("double"))
    out = judged.evaluate(rows, lambda prompts: ['{"questions": ["a b"]}' if '"questions"' in p else '{"verdict": 1}' for p in prompts], embed)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 2
    assert out.first()["answer_relevancy"] == 1.0
