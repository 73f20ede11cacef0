"""Context for a prompt: order, token budget, layout, statistics.

Chunks: query_id, chunk_id, text, score, rank, tokens, and for the layout page_number, section_title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESERVE, PER_CHUNK, LEAST = 200, 25, 200


def ordered(chunks: DataFrame, by_position: bool = False) -> DataFrame:
    """rank by score, or by source, page and index."""
    keys = ["source_id", F.coalesce("page_number", F.lit(0)), "chunk_index"] if by_position else [F.col("score").desc(), "chunk_id"]
    return chunks.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys)))


def sentence_prefix(text: Column, budget: Column, tokens) -> Column:
    """The leading '. '-sentences whose tokens fit the budget."""
    first = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def step(a, s):
        over = a["stop"] | (a["n"] + tokens(s) > budget)
        return F.struct(F.when(over, a["kept"]).otherwise(F.array_append(a["kept"], s)).alias("kept"), F.when(over, a["n"]).otherwise(a["n"] + tokens(s)).alias("n"), over.alias("stop"))

    return F.aggregate(F.split(text, r"\. "), first, step, lambda a: F.array_join(a["kept"], ". "))


def within_budget(chunks: DataFrame, max_tokens: int, tokens=None) -> DataFrame:
    """The longest prefix by rank whose tokens, and 25 a chunk, fit max_tokens - 200.

    With `tokens` (a column function), the chunk at which it ends is added in part, as leading sentences,
    if at least 200 tokens are left for it: its score falls to four fifths. Adds partial."""
    by = Window.partitionBy("query_id").orderBy("rank")
    budget = max_tokens - RESERVE
    used = F.sum(F.col("tokens") + PER_CHUNK).over(by.rowsBetween(Window.unboundedPreceding, 0))
    summed = chunks.withColumn("__used", used).withColumn("__before", F.col("__used") - F.col("tokens") - PER_CHUNK)
    whole = summed.where(F.col("__used") <= budget).withColumn("partial", F.lit(False))
    if tokens is not None:
        left = budget - F.col("__before") - PER_CHUNK
        part = summed.where((F.col("__used") > budget) & (F.col("__before") <= budget) & (left >= LEAST)).withColumn("text", sentence_prefix(F.col("text"), left, tokens)).where("text <> ''")
        part = part.withColumn("tokens", tokens(F.col("text"))).withColumn("score", F.col("score") * 0.8).withColumn("chunk_id", F.concat(F.col("chunk_id").cast("string"), F.lit("_partial"))).withColumn("partial", F.lit(True))
        whole = whole.withColumn("chunk_id", F.col("chunk_id").cast("string")).unionByName(part)
    return whole.drop("__used", "__before")


def assembled(chunks: DataFrame, plain: bool = False) -> DataFrame:
    """query_id, context: the chunks by rank, each as [i] with its page and section, and blank lines between."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    at = F.concat_ws(", ", F.concat(F.lit("Page "), F.col("page_number").cast("string")), F.concat(F.lit("Section: "), F.col("section_title")))
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]"))
    full = F.concat(head, F.lit(" "), F.col("text")) if plain else F.concat(head, F.when(at != "", F.concat(F.lit(" ("), at, F.lit(")"))).otherwise(""), F.lit("\n"), F.col("text"))
    listed = chunks.withColumn("n", n).select("query_id", "n", full.alias("t")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x"))
    return listed.select("query_id", F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("context"))


def statistics(chunks: DataFrame, max_tokens: int) -> DataFrame:
    return chunks.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("tokens").alias("tokens"), F.sum(F.length("text")).alias("chars"), F.countDistinct("source_id").alias("n_sources"),
        F.round(F.sum("tokens") / max_tokens * 100, 4).alias("utilisation"),
    )


def distinct_sentences(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"\. "), lambda p: F.trim(p)), lambda s: s != "")
    return F.array_join(F.array_distinct(parts), ". ")
