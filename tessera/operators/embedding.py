"""Vectors for texts, by an embedder that is handed in, and checks on what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import valid_vector


def embedded(rows: DataFrame, embed, text: str = "text", out: str = "embedding") -> DataFrame:
    """rows with a vector each; rows and vectors stay together, and blank texts have none."""
    return rows.withColumn(out, embed(F.col(text)))


def once_per_text(rows: DataFrame, embed, text: str = "text", out: str = "embedding") -> DataFrame:
    """As embedded, but repeated texts are embedded once."""
    keyed = rows.withColumn("__k", F.sha2(text, 256))
    made = keyed.select("__k", F.col(text).alias("__t")).dropDuplicates(["__k"]).withColumn(out, embed(F.col("__t"))).drop("__t")
    return keyed.join(made, "__k", "left").drop("__k")


def validity(vectors: DataFrame, dim: int, by: str | None = None, embedding: str = "embedding", least: float = 0.9) -> DataFrame:
    """Vectors, valid ones, their share, and whether that is enough."""
    ok = valid_vector(embedding, dim)
    counted = vectors.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"))
    return counted.withColumn("share", F.round(F.col("valid") / F.col("n"), 6)).withColumn("enough", F.col("valid") >= least * F.col("n"))


def processing(vectors: DataFrame, by: str, embedding: str = "embedding") -> DataFrame:
    """Per key: texts, those that got a vector, and the rate in %."""
    return vectors.groupBy(by).agg(F.count(F.lit(1)).alias("texts"), F.count(embedding).alias("embedded"), F.round(100 * F.count(embedding) / F.count(F.lit(1)), 4).alias("rate"))
