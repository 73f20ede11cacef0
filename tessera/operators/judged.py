"""Answers scored by a judge, a model handed in as call(list of prompts) -> list of replies.

An answer is cut into statements, each a row and a call of its own in batches; replies are JSON of a fixed form, and
what is not is asked for again. Verdicts are added up per answer by Spark. Responses that are not built on sources, or
lack a question or an answer, are rows that say why they were not evaluated.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.vectors import cosine
from .analytics import overall

Call = Callable[[list[str]], list[str]]
#: How often a reply that is not of the form is asked for again.
RETRIES = 2


def prompt(task: str, **parts: str) -> Column:
    """{"task": ..., part: the column's value} as JSON."""
    return F.to_json(F.struct(F.lit(task).alias("task"), *(F.col(c).alias(k) for k, c in parts.items())))


def verdict_of(reply: str) -> str:
    """The verdict of {"verdict": 0 or 1}, alone or in a fence; raises on anything else."""
    value = json.loads(reply.strip().removeprefix("```json").removeprefix("```").removesuffix("```"))["verdict"]
    if value not in (0, 1):
        raise ValueError(f"verdict {value!r}")
    return str(int(value))


def questions_of(reply: str) -> str:
    """The questions of {"questions": [text, ...]}, as JSON; raises on anything else."""
    found = json.loads(reply.strip().removeprefix("```json").removeprefix("```").removesuffix("```"))["questions"]
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise ValueError("questions are no texts")
    return json.dumps(found)


def asked(rows: DataFrame, call: Call, parse: Callable[[str], str], column: str = "prompt", retries: int = RETRIES) -> DataFrame:
    """rows with told (what parse makes of the reply; null if none was of the form), tries, and error (of the last try)."""

    @F.pandas_udf(T.StructType([T.StructField("told", T.StringType()), T.StructField("tries", T.IntegerType()), T.StructField("error", T.StringType())]))
    def run(prompts):
        import pandas as pd

        told: list = [(None, 0, None)] * len(prompts)
        texts = prompts.tolist()
        left = [i for i, p in enumerate(texts) if p is not None]
        for attempt in range(1, retries + 2):
            if not left:
                break
            try:
                replies = list(call([texts[i] for i in left]))
                if len(replies) != len(left):
                    raise ValueError(f"{len(replies)} replies to {len(left)} prompts")
            except Exception as e:  # noqa: BLE001  tried again, then reported
                replies = [e] * len(left)
            again = []
            for i, reply in zip(left, replies, strict=True):
                try:
                    if isinstance(reply, Exception):
                        raise reply
                    told[i] = (parse(reply), attempt, None)
                except Exception as e:  # noqa: BLE001  tried again, then reported
                    told[i] = (None, attempt, f"{type(e).__name__}: {e}")
                    again.append(i)
            left = again
        return pd.DataFrame(told, columns=["told", "tries", "error"])

    return rows.withColumn("__r", run(column)).select(*rows.columns, "__r.told", "__r.tries", "__r.error")


def evaluated(responses: DataFrame) -> DataFrame:
    """responses (id, query, answer, contexts) with evaluated and reason, as a response is fit for it."""
    none = F.coalesce(F.size("contexts"), F.lit(0)) <= 0
    lacking = (F.trim(F.coalesce("query", F.lit(""))) == "") | (F.trim(F.coalesce("answer", F.lit(""))) == "")
    reason = F.when(none, "Not a RAG response").when(lacking, "Missing query or answer")
    return responses.withColumn("reason", reason).withColumn("evaluated", reason.isNull())


def evaluate(responses: DataFrame, call: Call, embed: Callable[[Column], Column]) -> DataFrame:
    """id, evaluated, reason, faithfulness, context_relevancy, context_precision, context_recall, answer_relevancy, overall, asked_again.

    responses: id, query, answer, contexts (array), truth (may be null). faithfulness: the share of the answer's statements that the
    contexts bear out; context_recall: the same of the truth's; context_relevancy: the share of contexts that help with the
    question, context_precision: the mean precision at the ranks of those; answer_relevancy: the mean cosine of the question and
    those made back from the answer. Verdicts that were not to be had are left out; a metric without any is null."""
    fit = evaluated(responses)
    own = fit.where("evaluated").withColumn("context", F.array_join("contexts", "\n"))

    def statements(column: str, kind: str) -> DataFrame:
        rows = own.select("id", "context", F.posexplode(tx.sentences(column)).alias("at", "statement"))
        return rows.select("id", F.lit(kind).alias("kind"), "at", prompt("borne out", statement="statement", context="context").alias("prompt"))

    ranked = own.select("id", "query", F.posexplode("contexts").alias("at", "part"))
    useful = ranked.select("id", F.lit("context").alias("kind"), "at", prompt("useful", query="query", context="part").alias("prompt"))
    verdicts = asked(statements("answer", "answer").unionByName(statements("truth", "truth")).unionByName(useful), call, verdict_of).withColumn("v", F.col("told").cast("int"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("v"))
    # A response's contexts are few: its own array, in their order.
    seen = F.array_sort(F.collect_list(F.when((F.col("kind") == "context") & F.col("v").isNotNull(), F.struct("at", "v"))))
    summed = verdicts.groupBy("id").agg(F.avg(of("answer")).alias("faithfulness"), F.avg(of("truth")).alias("context_recall"), F.avg(of("context")).alias("context_relevancy"), seen.alias("seen"), F.sum((F.col("tries") > 1).cast("int")).alias("asked_again"))
    upto = lambda i: F.aggregate(F.slice("seen", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x["v"])
    gained = F.aggregate(F.transform("seen", lambda x, i: F.when(x["v"] == 1, upto(i) / (i + 1)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    helped = F.aggregate("seen", F.lit(0), lambda a, x: a + x["v"])
    summed = summed.withColumn("context_precision", F.when(F.size("seen") == 0, None).when(helped == 0, 0.0).otherwise(gained / helped)).drop("seen")

    made = asked(own.select("id", "query", prompt("questions", answer="answer").alias("prompt")), call, questions_of)
    # Vectors are columns of their own, each made once, whatever the cosine does with them.
    back = made.select("id", embed(F.col("query")).alias("query"), "told").select("id", "query", F.explode(F.from_json("told", "array<string>")).alias("question"))
    near = back.select("id", "query", embed(F.col("question")).alias("question")).select("id", cosine("query", "question").alias("near")).groupBy("id").agg(F.greatest(F.lit(0.0), F.avg("near")).alias("answer_relevancy"))
    scores = ["faithfulness", "context_relevancy", "context_precision", "context_recall", "answer_relevancy"]
    out = fit.select("id", "evaluated", "reason").join(summed, "id", "left").join(near, "id", "left")
    or_none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    whole = overall(or_none("answer_relevancy"), or_none("faithfulness"), or_none("context_relevancy"), F.col("context_precision"), F.lit(None).cast("double"))
    return out.select("id", "evaluated", "reason", *(F.round(c, 6).alias(c) for c in scores), F.when(F.col("evaluated"), whole).alias("overall"), F.coalesce("asked_again", F.lit(0)).cast("long").alias("asked_again"))
