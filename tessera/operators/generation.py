"""What goes before and after a model call: query class, prompt, temperature. The call itself is a plug-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import prompt_tokens, word_count

# The words that decide a prompt's type, in order; parts of words count.
PROMPT_WORDS = {
    "summary": ["summarize", "summary", "overview", "tldr", "brief"],
    "comparison": ["compare", "contrast", "difference", "versus", "vs"],
    "analytical": ["analyze", "analysis", "evaluate", "assess", "examine"],
    "extraction": ["extract", "list", "find all", "identify", "enumerate"],
    "creative": ["create", "write", "compose", "generate", "imagine"],
    "conversational": ["tell me about", "explain", "discuss", "talk about"],
}
TEMPERATURE_SHIFT = {"qa": -0.2, "creative": 0.3, "analytical": -0.1, "summary": -0.15, "comparison": 0.1}
FACTUAL = ["what is", "who is", "when did", "where is", "how many", "how much", "number of", "definition of", "meaning of", "calculate"]
WINDOWS = {"gpt-3.5-turbo": 4096, "mistral:7b": 8192}
#: The share of the window that a context may fill; fixed values.
CONTEXT_SHARE = {"qa": 0.6, "summary": 0.8, "analytical": 0.7, "comparison": 0.5, "extraction": 0.6, "creative": 0.4, "conversational": 0.5}
INSTRUCTIONS = {
    "qa": "Answer the question from the context alone.",
    "summary": "Sum up the context.",
    "comparison": "Compare what the context says about each side.",
    "analytical": "Analyse the context and reason step by step.",
    "extraction": "List what the context states about the request.",
    "creative": "Write freely, but stay true to the context.",
    "conversational": "Explain the matter in a friendly tone, from the context.",
}


def _holds(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def prompt_type(query: Column) -> Column:
    q = F.lower(query)
    out = None
    for kind, words in PROMPT_WORDS.items():
        out = F.when(_holds(q, words), kind) if out is None else out.when(_holds(q, words), kind)
    return out.otherwise("qa")


def complexity(query: Column) -> Column:
    q, n = F.lower(F.coalesce(query, F.lit(""))), word_count(query)
    return F.when(q == "", 0.5).when(_holds(q, ["compare", "contrast", "difference"]), 0.8).when(_holds(q, ["why", "how", "explain"]) & (n > 15), 0.7).when(n > 20, 0.6).otherwise(0.3)


def context_quality(context: Column) -> Column:
    """Mean of length (500 words are enough), citations (5 are), and how near sentences are to 20 words."""
    c = F.coalesce(context, F.lit(""))
    words = word_count(c)
    stops = F.regexp_count(c, F.lit(r"\."))
    length, cited = F.least(words / 500, F.lit(1.0)), F.least(F.regexp_count(c, F.lit(r"\[")) / 5, F.lit(1.0))
    even = 1 - F.least(F.abs(words / stops - 20) / 50, F.lit(1.0))
    return F.when(c == "", 0.0).when(stops > 0, (length + cited + even) / 3).otherwise((length + cited) / 2)


def temperature(query: Column, context: Column, kind: Column, base: float = 0.1, least: float = 0.1, most: float = 0.8) -> Column:
    """By kind, complexity, and whether the context is poor; rounded and kept in range."""
    shift = F.lit(0.0)
    for k, v in TEMPERATURE_SHIFT.items():
        shift = F.when(kind == k, v).otherwise(shift)
    c = complexity(query)
    t = base + shift + F.when(c > 0.7, 0.1).when(c < 0.3, -0.1).otherwise(0.0)
    t = t + F.when((F.coalesce(context, F.lit("")) != "") & (context_quality(context) < 0.5), 0.15).otherwise(0.0)
    return F.round(F.greatest(F.lit(least), F.least(t, F.lit(most))), 2)


def confidence_temperature(mean_score: Column, kind: Column, base: float = 0.1, high: float = 0.1, low: float = 0.7) -> Column:
    t = F.when(mean_score > 0.8, high).when(mean_score < 0.3, low).otherwise(high + (low - high) * (1 - (mean_score - 0.3) / 0.5))
    t = F.when(kind == "creative", F.least(F.lit(0.9), t + 0.2)).when(kind == "qa", F.greatest(F.lit(0.1), t - 0.1)).otherwise(t)
    return F.round(F.when(mean_score.isNull(), base).otherwise(F.greatest(F.lit(0.0), F.least(t, F.lit(1.0)))), 2)


def progressive_temperature(query: Column, kind: Column, base: float = 0.1) -> Column:
    return F.when(kind == "creative", 0.8).when(kind == "analytical", 0.3).when((kind == "qa") & factual(query), 0.1).when(kind == "qa", 0.4).when(kind == "summary", 0.2).otherwise(base)


def factual(query: Column) -> Column:
    return _holds(F.lower(query), FACTUAL)


def sampling(t: Column) -> dict[str, Column]:
    return {"top_p": F.when(t < 0.3, 0.95).when(t > 0.7, 0.7).otherwise(0.9), "presence_penalty": F.when(t > 0.5, 0.1).otherwise(0.0)}


def window(model: Column, default: int = 8192) -> Column:
    out = F.lit(default)
    for name, size in WINDOWS.items():
        out = F.when(model == name, size).otherwise(out)
    return out


def prompts(rows: DataFrame, size: int = 8192, completion: int = 1000) -> DataFrame:
    """query_id, kind, system, user, tokens, fits. rows: query_id, query, context.

    The context is cut to whole words within the smaller of what the completion leaves and its kind's share of the window."""
    kind = prompt_type(F.col("query"))
    system = F.lit(INSTRUCTIONS["qa"])
    for k, text in INSTRUCTIONS.items():
        system = F.when(F.col("kind") == k, text).otherwise(system)
    fixed = rows.withColumn("kind", kind).withColumn("system", system)
    most = F.lit(int(size * CONTEXT_SHARE["qa"]))
    for k, share in CONTEXT_SHARE.items():
        most = F.when(F.col("kind") == k, int(size * share)).otherwise(most)
    room = F.least(F.lit(size - completion - 100) - prompt_tokens("system") - prompt_tokens("query"), most)
    # The estimate is 1.3 * 1.05 tokens a word.
    words = F.filter(F.split("context", r"\s+"), lambda w: w != "")
    keep = F.greatest(F.lit(0), F.floor(room / 1.365)).cast("int")
    context = F.when(prompt_tokens("context") <= room, F.col("context")).otherwise(F.array_join(F.slice(words, F.lit(1), keep), " "))
    user = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), F.col("query"))
    made = fixed.select("query_id", "kind", "system", user.alias("user")).withColumn("tokens", prompt_tokens("system") + prompt_tokens("user"))
    return made.withColumn("fits", F.col("tokens") + completion <= size)


def query_class(reply: Column) -> Column:
    """A classifier's reply as (type, confidence): JSON, fenced or bare; failing that, by its words."""
    bare = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(bare, "type string, confidence double")
    ok = F.coalesce(parsed["type"].isin("rag", "general"), F.lit(False))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed["confidence"], F.lit(0.5))))
    fallback = F.when(F.lower(reply).contains("general"), "general").otherwise("rag")
    return F.struct(F.when(ok, parsed["type"]).otherwise(fallback).alias("type"), F.when(ok, sure).otherwise(0.6).alias("confidence"))


def answered(rows: DataFrame, call, column: str = "user", out: str = "answer") -> DataFrame:
    """rows with the replies of call(list of texts) -> list of texts, batch by batch, and `<out>_error`.

    A batch that fails, or comes back short, is asked again text by text, so that the texts at fault alone are without
    a reply; what went wrong with them is in the error column."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.StructType([T.StructField("said", T.StringType()), T.StructField("error", T.StringType())]))
    def run(texts):
        import pandas as pd

        def alone(text) -> tuple[str | None, str | None]:
            try:
                return call([text])[0], None
            except Exception as e:  # noqa: BLE001  the row says so
                return None, f"{type(e).__name__}: {e}"

        asked = texts.tolist()
        try:
            said = [(x, None) for x in call(asked)]
        except Exception:  # noqa: BLE001  asked again
            said = []
        return pd.DataFrame(said if len(said) == len(asked) else [alone(x) for x in asked], columns=["said", "error"])

    held = rows.withColumn("__reply", run(column))
    return held.withColumns({out: F.col("__reply.said"), f"{out}_error": F.col("__reply.error")}).drop("__reply")


#: What is said when no model answers; fixed by the hash of the question.
GREETINGS = ["Hello, how can I help you with your documents?", "I can look things up in your documents. What would you like to know?", "Ask me about the documents that you have uploaded."]


def general_prompts(rows: DataFrame, kept: int = 5) -> DataFrame:
    """rows (query_id, query, history: array of role and text) with user, the last turns and the question, and fallback, a stock reply."""
    turns = F.transform(F.slice("history", F.greatest(F.lit(1), F.size("history") - kept + 1), kept), lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    stock = F.element_at(F.array(*map(F.lit, GREETINGS)), (F.pmod(F.crc32("query"), F.lit(len(GREETINGS))) + 1).cast("int"))
    return rows.withColumn("user", F.concat_ws("\n", F.array_join(turns, "\n"), F.concat(F.lit("user: "), F.col("query")))).withColumn("fallback", stock)


def responses(asked: DataFrame, hits: DataFrame, classify, call, max_tokens: int = 8192) -> DataFrame:
    """query_id, kind, answer, cited: each question routed to documents or to talk, answered by call, citations counted anew.

    asked: query_id, query; hits: chunks of the questions, as context.assembled takes them; classify(queries column)
    -> reply column of a classifier, for query_class; call: as for answered(). A question whose call fails, or that has
    no chunks, gets a stock reply."""
    from . import citations, context

    sorted_ = asked.withColumn("kind", query_class(classify(F.col("query")))["type"])
    chosen = context.within_budget(hits, max_tokens)
    n = chosen.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_sources"))
    with_text = sorted_.join(context.assembled(chosen), "query_id", "left").join(n, "query_id", "left")
    known = with_text.where((F.col("kind") == "rag") & F.col("context").isNotNull())
    said = answered(prompts(known.select("query_id", "query", "context")).select("query_id", "user"), call)
    none = F.array().cast("array<struct<role:string,text:string>>")
    stock = general_prompts(with_text.select("query_id", "query", none.alias("history"))).select("query_id", "fallback")
    made = with_text.join(said.select("query_id", "answer"), "query_id", "left").join(stock, "query_id")
    answer = F.coalesce(citations.renumbered(F.col("answer"), F.coalesce("n_sources", F.lit(0))), F.col("fallback"))
    return made.select("query_id", "kind", answer.alias("answer"), F.size(citations.extracted(answer)).alias("cited"))
