"""Text from recognised boxes: lines by vertical gaps, kinds of line, table rows.

Boxes: page_id, text, confidence, cx, cy, x0, x1, height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_CONFIDENCE, NEW_LINE, WORD_GAP, CELL_GAP, PARAGRAPH = 0.5, 25, 5, 30, 35


def lines(boxes: DataFrame) -> DataFrame:
    """page_id, line, text, kind, paragraph: boxes from top to bottom and left to right."""
    # A page's boxes become one row where they lie: what is shuffled and sorted are pages, not boxes.
    own = F.struct("cy", "cx", "text", "x0", "x1", "height")
    pages = boxes.where(F.col("confidence") > LEAST_CONFIDENCE).groupBy("page_id").agg(F.sort_array(F.collect_list(own)).alias("boxes"))
    at = F.sequence(F.lit(0), F.size("boxes") - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.abs(F.get("boxes", i)["cy"] - F.get("boxes", i - 1)["cy"]) >= NEW_LINE))
    cut = pages.withColumn("starts", starts).select("page_id", F.posexplode(F.transform("starts", lambda s, i: F.slice("boxes", s + 1, F.coalesce(F.get("starts", i + 1), F.size("boxes")) - s))).alias("line", "b"))
    known = F.size(F.filter("b", lambda x: x["cy"].isNotNull()))
    mean = F.when(known > 0, F.aggregate("b", F.lit(0.0), lambda a, x: a + F.coalesce(x["cy"], F.lit(0.0))) / known)
    across = cut.select("page_id", F.col("line").cast("long").alias("line"), F.sort_array(F.transform("b", lambda x: F.struct(x["cx"].alias("cx"), x["text"].alias("text"), x["x0"].alias("x0"), x["x1"].alias("x1"), x["height"].alias("height")))).alias("b"), mean.alias("cy"))
    first = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("x"))

    def put(a, b):
        space = F.when(a["x"].isNull() | (b["x0"] - a["x"] <= WORD_GAP), "").otherwise(" ")
        return F.struct(F.concat(a["t"], space, b["text"]).alias("t"), b["x1"].cast("double").alias("x"))

    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("b") - 1)), lambda i: F.get("b", i)["x0"] - F.get("b", i - 1)["x1"])
    table = (F.size("b") >= 2) & F.exists(gaps, lambda g: g > CELL_GAP)
    plain = F.aggregate("b", first, put, lambda a: a["t"])
    text = F.when(table, F.array_join(F.transform("b", lambda x: x["text"]), " | ")).otherwise(plain)
    tall = F.exists("b", lambda x: x["height"] > 25)
    out = across.select("page_id", "line", "cy", text.alias("text"), table.alias("table"), tall.alias("tall"))
    by = Window.partitionBy("page_id").orderBy("line")
    gap = F.coalesce(F.col("cy") - F.lag("cy").over(by), F.lit(0))
    return out.withColumn("kind", F.when(F.col("table"), "table").when(bullet(F.col("text")), "bullet").when(heading(F.col("text"), F.col("tall")), "heading").otherwise("text")).withColumn("paragraph", F.sum((gap > PARAGRAPH).cast("int")).over(by)).select("page_id", "line", "text", "kind", "paragraph")


def bullet(text: Column) -> Column:
    return F.trim(text).rlike(r"^([•●▪◦*\-–]|\d+[.):]|[a-z][.):])\s")


def heading(text: Column, tall: Column) -> Column:
    """Mostly capitals, or mostly title case in a tall line."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    capital = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / F.greatest(F.lit(1), letters)
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^\p{L}"))
    title = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) / F.greatest(F.lit(1), F.size(words))
    return (capital > 0.7) | tall & (letters > 0) & (title > 0.8)


def artefact(text: Column) -> Column:
    """Page numbers and specks."""
    t = F.trim(text)
    return (F.length(t) < 2) | t.rlike(r"^\d{1,3}$") | t.rlike(r"^[^\p{L}\p{N}]{1,3}$")


def page_text(found: DataFrame) -> DataFrame:
    """page_id, text: lines without artefacts, a blank line between paragraphs."""
    rows = found.where(~artefact(F.col("text"))).groupBy("page_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("x"))
    body = rows.select("page_id", "paragraph", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("t"))
    listed = body.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("paragraph", "t"))).alias("x"))
    return listed.select("page_id", F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("text"))
