"""Keyword and vector retrieval for many queries at once, fusion, and re-ranking.

Ranked lists have query_id, doc_id, score, rank (from 1). Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.shared import new_path
from .postings import best, blocked, counts, in_blocks, weighted

BLOCK = 4096
#: Of a text, about; a block may hold three times the terms that they tell.
BYTES_PER_TERM = 6


def ranked(scores: DataFrame, k: int | None = None, by: str = "score") -> DataFrame:
    """scores with rank, cut to k; the limit is applied before the shuffle as well.

    Sums differ in their last digits by the order in which they are added up: ties are those of nine digits."""
    w = Window.partitionBy("query_id").orderBy(F.round(by, 9).desc(), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, length) of the BM25 terms of (doc_id, text)."""
    own = docs.select("doc_id", tx.bm25_terms("text").alias("terms"))
    flat = own.select("doc_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return flat.groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_statistics(index: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, total_tf, idf)."""
    return weighted(index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")), n_docs).select("term", "df", "total_tf", "idf")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top k of docs (doc_id, text) for each of queries (query_id, text), without a stored index.

    Texts are shuffled to their blocks, by what their bytes tell of their length, and cut into terms there; blocks are written to the shared folder."""
    spark, at = docs.sparkSession, new_path(docs.sparkSession)
    own = docs.select("doc_id", "text", F.coalesce(F.floor(F.octet_length("text") / BYTES_PER_TERM), F.lit(0)).cast("int").alias("length"))
    in_blocks(blocked(own), packed=docs.schema["doc_id"].dataType.typeName() == "long").write.parquet(f"{at}/blocks")
    blocks = spark.read.parquet(f"{at}/blocks")
    counts(blocks).write.parquet(f"{at}/counts")
    counted, n = spark.read.parquet(f"{at}/counts"), docs.count()
    total = counted.agg(F.sum("total_tf")).first()[0]
    return ranked(best(blocks, weighted(counted, n), queries, total / n if total else 1.0, k)[0], k)


def _blocked(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)))


def finite(rows: DataFrame) -> DataFrame:
    """rows whose embedding is there and holds finite numbers alone."""
    return rows.where(F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


def nearest_within(left: pd.DataFrame, right: pd.DataFrame, k: int, same: bool = True) -> pd.DataFrame:
    """query_id, doc_id, distance: of rows (doc_id, v) the k nearest to each of (query_id, v), those of a dimension together."""
    asked, found, distances = [], [], []
    if len(left) and len(right):
        sides = [(left[left.v.map(len) == d], right[right.v.map(len) == d]) for d in sorted(set(left.v.map(len)) & set(right.v.map(len)))]
    else:
        sides = []
    for left, right in sides:
        ids, x = left.doc_id.to_numpy(), np.array(left.v.tolist()).reshape(len(left), -1)
        squares = (x**2).sum(1)
        for at in range(0, len(right), 256):
            part = right.iloc[at : at + 256]
            q = np.array(part.v.tolist()).reshape(len(part), -1)
            near = squares[None, :] - 2 * q @ x.T  # but for the query's own square, the distance
            if not same:
                near[part.query_id.to_numpy()[:, None] == ids[None, :]] = np.inf
            kept = np.argpartition(near, min(k + 8, near.shape[1] - 1), axis=1)[:, : k + 9]
            for query, one, row, pick in zip(part.query_id, q, near, kept, strict=True):
                # Distances cancel in products: the nearest and what comes close to them are measured outright.
                least = row[pick].max()
                pick = np.flatnonzero(row <= least + 1e-9 * (1 + abs(least))) if np.isfinite(least) else pick[np.isfinite(row[pick])]
                d2 = ((x[pick] - one) ** 2).sum(1)
                best = np.lexsort((ids[pick], d2))[:k]
                asked.append(np.repeat(query, len(best))), found.append(ids[pick][best]), distances.append(d2[best])
    if asked:
        return pd.DataFrame({"query_id": np.concatenate(asked), "doc_id": np.concatenate(found), "distance": np.concatenate(distances)})
    return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []}).astype({"query_id": "i8", "doc_id": "i8"})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, same: bool = True) -> DataFrame:
    """Exact top k by squared Euclidean distance; score = 1 / (1 + distance).

    vectors: doc_id, embedding; queries: query_id, embedding; same: whether a row may find its own id.
    Both sides come in blocks, each pair of blocks a matrix product in a task of its own. Vectors that are null, or hold
    null or non-finite components, find and are found by nothing; a query meets the rows of its own dimension."""
    vectors, queries = finite(vectors), finite(queries)
    n_v, n_q = vectors.count() // BLOCK + 1, queries.count() // BLOCK + 1
    v = _blocked(vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL"), "doc_id", n_v, "bv")
    q = _blocked(queries.select("query_id", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL"), "query_id", n_q, "bq")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v, q = v.withColumn("bq", every(n_q)), q.withColumn("bv", every(n_v))

    met = v.groupBy("bv", "bq").cogroup(q.groupBy("bv", "bq")).applyInPandas(lambda left, right: nearest_within(left, right, k, same), "query_id long, doc_id long, distance double")
    return ranked(met.withColumn("score", F.when(F.col("distance") <= 0, 1.0).otherwise(1 / (1 + F.col("distance")))), k)


def filtered(hits: DataFrame, keep: Column, k: int) -> DataFrame:
    """Filter a list that was fetched longer, then cut; ranks stay those of the unfiltered list."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.where(keep).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def normalised(hits: DataFrame) -> DataFrame:
    """Scores from 0 to 1 within each list; 0.5 where they hardly differ."""
    w = Window.partitionBy("query_id")
    span = F.max("score").over(w) - F.min("score").over(w)
    return hits.withColumn("score", F.when(span < 1e-6, 0.5).otherwise((F.col("score") - F.min("score").over(w)) / span))


def fused(lists: list[tuple[DataFrame, float]], k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of weighted lists, the best at 1. One list alone passes through."""
    if len(lists) == 1:
        return lists[0][0].where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")
    parts = [hits.select("query_id", "doc_id", (F.lit(weight) / (constant + F.col("rank"))).alias("part")) for hits, weight in lists]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    total = joined.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    scaled = total.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    return ranked(scaled, k).select("query_id", "doc_id", "score", "rank")


def reranked(hits: DataFrame, scorer: Column, k: int) -> DataFrame:
    """Order anew by scorer (a column of the hits), min-max scaled; the old rank decides ties."""
    scored = normalised(hits.withColumn("score", scorer))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank"))
    return scored.withColumn("new", F.row_number().over(w)).where(F.col("new") <= k).withColumn("rank", F.col("new")).drop("new")


def overlap_scorer(query: str, text: str) -> Column:
    """A lexical stand-in for a cross-encoder: the share of the query's terms that the text has."""
    q = F.array_distinct(tx.bm25_terms(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tx.bm25_terms(text))) / F.size(q))


def hybrid(docs: DataFrame, queries: DataFrame, k: int = 10, vector_weight: float = 0.6, keyword_weight: float = 0.4) -> DataFrame:
    """Both legs at 2k, fused. docs: doc_id, text, embedding; queries: query_id, text, embedding."""
    return fused([(nearest(docs, queries, 2 * k), vector_weight), (bm25(docs, queries, 2 * k), keyword_weight)], k)


def diverse(hits: DataFrame, source: str = "source_id", penalty: float = 0.1) -> DataFrame:
    """Scores less a penalty for each further hit of the same source; those left without a score go."""
    by, all_ = Window.partitionBy("query_id", source), Window.partitionBy("query_id")
    alone = F.count(F.lit(1)).over(all_) == 1
    less = F.when(alone, F.col("score")).otherwise(F.col("score") - penalty * (F.count(F.lit(1)).over(by) - 1))
    cut = hits.withColumn("score", less).where("score > 0")
    best = F.max("score").over(all_)
    return cut.withColumn("score", F.col("score") / best)


def above(hits: DataFrame, least: float, fallback: int = 5) -> DataFrame:
    """Hits of at least that score; for a query without any, its best few."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("__n", F.row_number().over(w)).withColumn("__b", best).where((F.col("score") >= least) | ((F.col("__b") < least) & (F.col("__n") <= fallback))).drop("__n", "__b")
