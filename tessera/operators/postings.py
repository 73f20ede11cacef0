"""BM25 top k over postings in blocks, with bounds: exact, and without a row for each document and query.

A block holds documents of about one length, BLOCK_DOCS at most; a row is a term's postings within a block, with the
largest count and the least length among them, which bound what the term can add to a score there. Each
query first scores the block that promises most; its k-th score is then what any other block has to promise.
What meets are blocks and queries that share terms, not documents and queries: a term that all documents
hold has as many rows as there are blocks. Within a task a block's postings become arrays; many queries are
scored together, the terms that many of them share as a matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.shared import new_path, release

K1, B = 1.5, 0.75
#: Documents of a block, terms in them on average, and queries that meet a block in one task, at most.
BLOCK_DOCS, BLOCK_TERMS, QUERY_BLOCK = 16_384, 4_000_000, 65_536
#: Pairs of blocks and queries that meet at a time; each moves its query's terms, and pairs grow as blocks times queries.
PAIRS = 2_000_000
#: Between the terms of a document that move as one string.
BETWEEN = "\x1f"
#: A term that more than one in so many of a block's documents hold is a row of all of them.
DENSE = 8
#: Fewer queries than that are scored one by one. Scores of a chunk of queries, and of a step within it, at most.
FEW, CHUNK, STEP = 16, 4_000_000, 100_000
#: What a posting costs in a sum, of what a document costs in a product; documents that filling a row is worth.
SUM_COST, ROW_COST = 400, 30


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(tx.bm25_terms("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def impact(tf, length, mean: float):
    """What a posting adds for an idf of one; rises with tf, falls with length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def blocked(own: DataFrame, within: str | None = None) -> DataFrame:
    """own (doc_id, length, ...) with block: classes of lengths (within a column's values), each dealt over as many blocks as it needs."""
    by = [within, "class"] if within else ["class"]
    classed = own.withColumn("class", F.when(F.col("length") > 0, F.floor(F.log2("length") * 2)).otherwise(-1).cast("int"))
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("length") / BLOCK_TERMS))
    parts = classed.groupBy(*by).agg(needed.alias("parts"))  # some sixty rows, of each value
    dealt = classed.join(F.broadcast(parts), by)
    return dealt.withColumn("block", F.concat_ws(".", *by, F.pmod(F.xxhash64("doc_id"), F.col("parts")))).drop("class", "parts")


def in_blocks(own: DataFrame, packed: bool = False) -> DataFrame:
    """own (block, doc_id, terms) or (block, doc_id, text) as rows (block, term, docs, tfs, lengths, max_tf, min_length, df, total_tf).

    packed, for ids that are longs: docs, tfs and lengths are the bytes of longs and integers, not arrays, which Spark moves as they are.
    What is shuffled are documents, to their block; it is inverted in one task, as arrays. Texts are cut at white space as they stand,
    and each distinct word of a block is cleaned once."""
    column = "terms" if "terms" in own.columns else "text"
    # As one string, a document's terms take two fifths of an array's room in the shuffle.
    own = own.select("block", "doc_id", column if column == "text" else F.concat_ws(BETWEEN, "terms").alias("terms"))
    ids = own.schema["doc_id"].dataType.simpleString()

    def invert(key: tuple, docs: pa.Table) -> pa.Table:
        docs = docs.sort_by("doc_id").combine_chunks()
        ids, lists = (docs.column(c).combine_chunks() for c in ("doc_id", column))
        lists = pc.fill_null(lists, "")
        lists = pc.ascii_split_whitespace(lists) if column == "text" else pc.split_pattern(lists, BETWEEN)
        words, own_doc = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
        own_term, terms = words.indices.to_numpy(), words.dictionary
        # A document without terms is split into one empty word.
        cleaned = (tx.bare_terms(terms) if column == "text" else pc.if_else(pc.equal(terms, ""), pa.scalar(None, terms.type), terms)).dictionary_encode()
        own_term, terms = pc.fill_null(cleaned.indices, -1).to_numpy()[own_term], cleaned.dictionary
        own_term, own_doc = own_term[own_term >= 0], own_doc[own_term >= 0]
        # Equal pairs of term and document lie side by side once sorted.
        pairs, tfs = np.unique(own_term.astype("i8") * max(1, len(ids)) + own_doc, return_counts=True)
        term, doc = np.divmod(pairs, max(1, len(ids)))
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        offsets = pa.array(np.append(starts, len(pairs)).astype("i4"))
        length, tfs = np.bincount(own_doc, minlength=len(ids)).astype("i4")[doc], tfs.astype("i4")

        def listed(x: pa.Array) -> pa.Array:
            if not packed:
                return pa.ListArray.from_arrays(offsets, x)
            data = x.to_numpy()  # fails on nulls
            return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(pairs)).astype("i4") * np.int32(data.itemsize)), pa.py_buffer(data)])

        of_term = lambda f, x: f.reduceat(x, starts) if len(starts) else x
        return pa.table({
            "block": pa.array([key[0].as_py()] * len(starts), pa.string()), "term": terms.take(pa.array(term[starts])).cast(pa.string()),
            "docs": listed(ids.take(pa.array(doc))), "tfs": listed(pa.array(tfs)), "lengths": listed(pa.array(length)),
            "max_tf": pa.array(of_term(np.maximum, tfs)), "min_length": pa.array(of_term(np.minimum, length)),
            "df": pa.array(np.diff(np.append(starts, len(pairs)))), "total_tf": pa.array(of_term(np.add, tfs.astype("i8"))),
        })

    docs_type, int_type = ("binary", "binary") if packed else (f"array<{ids}>", "array<int>")
    return own.groupBy("block").applyInArrow(invert, f"block string, term string, docs {docs_type}, tfs {int_type}, lengths {int_type}, max_tf int, min_length int, df long, total_tf long")


def unpacked(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, pa.Array]:
    """How many values each row of arrays, or of their bytes, holds, and all values."""
    rows = column.combine_chunks()
    if not pa.types.is_binary(rows.type):
        return rows.value_lengths().to_numpy(), rows.flatten()
    ends = np.frombuffer(rows.buffers()[1], "i4")[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, "i4")
    data = np.frombuffer(rows.buffers()[2], "u1", ends[-1] - ends[0], ends[0]) if ends[-1] > ends[0] else np.zeros(0, "u1")
    values = data.view(kind)
    return np.diff(ends) // values.itemsize, pa.array(values)


def counts(blocks: DataFrame) -> DataFrame:
    """(term, df, total_tf) of blocks' postings."""
    return blocks.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))


def promises(blocks: DataFrame, asked: DataFrame, mean: float) -> DataFrame:
    """(block, query_id, most): what no document of the block can exceed, of asked (query_id, term, weight)."""
    bound = F.greatest(F.lit(0.0), F.col("weight")) * impact(F.col("max_tf"), F.col("min_length"), mean)
    met = blocks.select("block", "term", "max_tf", "min_length").join(asked, "term")
    return met.groupBy("block", "query_id").agg(F.sum(bound).alias("most")).where("most > 0")


def frequent(at: np.ndarray, adds: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms that more than one in DENSE of n documents hold: each term's row (-1: none) and a row of what it adds to each document."""
    dense = np.flatnonzero(np.diff(ends) * DENSE > n)
    row_of, whole = np.full(len(ends) - 1, -1), np.zeros((len(dense), n))
    row_of[dense] = np.arange(len(dense))
    for row, i in enumerate(dense):
        whole[row, at[ends[i] : ends[i + 1]]] = adds[ends[i] : ends[i + 1]]
    return row_of, whole


def finished(total: np.ndarray, whole: np.ndarray, tops: np.ndarray, rows: np.ndarray, weights: np.ndarray, lowest: float, k: int, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents that may be among the best k, with what rows of `whole` (of which `tops` has the largest) add to total; all others surely are not.

    Rows are added to all documents, those that can add most first, until few documents can still come up to the k-th of
    what is summed so far or to `lowest`; the remaining rows are added to those alone."""
    most = weights * tops[rows]
    order = np.argsort(-most, kind="stable")
    rows, weights, left = rows[order], weights[order], np.append(np.cumsum(most[order][::-1])[::-1], 0.0)
    if (weights < 0).any():
        return np.arange(len(total)), total + weights @ whole[rows]
    for done in range(len(rows) + 1):
        if done % 4 == 0 or done == len(rows):
            edge = lowest
            if len(total) > k and (done or not lowest):
                edge = max(edge, np.partition(np.where(stay, total, -1.0), len(total) - k)[len(total) - k])
            pick = np.flatnonzero(total >= edge - left[done] - 1e-8)
            if done == len(rows) or len(pick) * DENSE < len(total):
                break
        total += weights[done] * whole[rows[done]]
    return pick, total[pick] + weights[done:] @ whole[np.ix_(rows[done:], pick)]


def totals(at: np.ndarray, adds: np.ndarray, ends: np.ndarray, n: int, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n_queries: int) -> np.ndarray:
    """Each query's score of each of n documents. Postings of term i are at[ends[i]:ends[i + 1]], the documents, with what they add;
    (query, term, weight) are the queries' terms, ordered by query.

    Terms that fill much of the scores become rows of all documents, which a product adds up; of the others, postings are."""
    held = np.diff(ends)
    gain = np.bincount(term, minlength=len(held)) * held
    rows = np.flatnonzero(gain * SUM_COST > n * (n_queries + ROW_COST))
    rows = rows[np.argsort(-gain[rows], kind="stable")[: CHUNK // n]]
    row_of, whole = np.full(len(held), -1), np.zeros((len(rows), n))
    row_of[rows] = np.arange(len(rows))
    for row, i in enumerate(rows):
        whole[row, at[ends[i] : ends[i + 1]]] = adds[ends[i] : ends[i + 1]]
    dense = row_of[term] >= 0
    shares = np.zeros((n_queries, len(rows)))
    shares[query[dense], row_of[term[dense]]] = weight[dense]
    total = shares @ whole
    query, term, weight, step = query[~dense], term[~dense], weight[~dense], max(1, STEP // n)
    for first in range(0, n_queries, step):
        i, j = np.searchsorted(query, [first, first + step])
        part, many = total[first : first + step], held[term[i:j]]
        own = np.repeat(ends[term[i:j]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cells = np.repeat((query[i:j] - first) * n, many) + at[own]
        part += np.bincount(cells, np.repeat(weight[i:j], many) * adds[own], minlength=part.size).reshape(part.shape)
    return total


def chunk_best(total: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's best k scores over 0 and of `least`; ties of nine digits go to the smaller column."""
    edge = np.maximum(least - 1e-9, np.nextafter(0, 1))
    many = np.flatnonzero((total >= edge[:, None]).sum(1) > 4 * k)
    for some in np.array_split(many, len(many) * total.shape[1] // STEP + 1) if len(many) else ():  # ties at the end stay in
        edge[some] = np.maximum(edge[some], np.partition(total[some], total.shape[1] - k, axis=1)[:, total.shape[1] - k] - 1e-8)
    row, column = np.nonzero(total >= edge[:, None])
    score = total[row, column]
    order = np.lexsort((column, -np.round(score, 9), row))
    order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
    return row[order], column[order], score[order]


def scored_pairs(blocks: DataFrame, pairs: DataFrame, asked: DataFrame, mean: float, k: int, parts: int, gone: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): each pair's (block, query_id, least) best k with a score over 0 and of `least`.

    gone: (block, doc_id) that are left out; they come as a row of their block without a term. Packed blocks have none."""
    terms = asked.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    wanted = pairs.join(terms, "query_id").select(F.col("block").alias("at"), part.alias("of"), "query_id", F.col("least").cast("double").alias("least"), "terms", "weights")
    held = blocks.select("block", "term", "docs", "tfs", "lengths").join(asked.select("term").distinct(), "term", "left_semi").select("block", "term", "docs", "tfs", "lengths")
    if gone is not None:
        none = F.array().cast("array<int>")
        held = held.unionByName(gone.groupBy("block").agg(F.collect_set("doc_id").alias("docs")).select("block", F.lit(None).cast("string").alias("term"), "docs", none.alias("tfs"), none.alias("lengths")))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = held.join(pairs.select(F.col("block"), part.alias("part")).distinct(), ["block", "part"], "left_semi")
    docs_type = blocks.schema["docs"].dataType
    id_type, query_type = "bigint" if docs_type.typeName() == "binary" else docs_type.elementType.simpleString(), pairs.schema["query_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = unpacked(left.filter(pc.is_null(left.column("term"))).column("docs"), "i8")[1]
        left, right = left.filter(pc.is_valid(left.column("term"))), right.combine_chunks()
        term, (held, docs), (_, tfs), (_, lengths) = left.column("term").combine_chunks(), unpacked(left.column("docs"), "i8"), unpacked(left.column("tfs"), "i4"), unpacked(left.column("lengths"), "i4")
        ends = np.append(0, np.cumsum(held))
        coded = docs.dictionary_encode()
        ids = coded.dictionary.take(by_id := pc.sort_indices(coded.dictionary))  # documents by id, which decides ties
        at = np.argsort(by_id.to_numpy())[coded.indices.to_numpy()]
        adds = impact(tfs.to_numpy().astype(float), lengths.to_numpy().astype(float), mean)
        stay = np.asarray(pc.invert(pc.is_in(ids, value_set=out)))
        queries, least, own, weights = (right.column(c).combine_chunks() for c in ("query_id", "least", "terms", "weights"))
        places = pc.fill_null(pc.index_in(own.flatten(), value_set=term), -1).to_numpy()
        least, weights, until = least.to_numpy(), weights.flatten().to_numpy(), np.append(0, np.cumsum(own.value_lengths().to_numpy()))
        rows, found, scores = [], [], []
        together = len(least) if len(least) >= FEW and len(ids) else 0
        step = max(1, CHUNK // max(1, len(ids)))
        of = np.repeat(np.arange(len(least)), np.diff(until))
        for first in range(0, together, step):
            until_here = min(first + step, together)
            p, w, q = (x[until[first] : until[until_here]] for x in (places, weights, of))
            total = totals(at, adds, ends, len(ids), q[p >= 0] - first, p[p >= 0], w[p >= 0], until_here - first)
            total[:, ~stay] = 0
            row, pick, score = chunk_best(total, least[first:until_here], k)
            rows.append(row + first), found.append(pick), scores.append(score)
        row_of, whole = frequent(at, adds, ends, len(ids)) if not together else (None, np.zeros((0, 0)))
        tops = whole.max(axis=1, initial=0.0)
        for row, lowest in enumerate(least) if not together else ():
            p, w = places[until[row] : until[row + 1]], weights[until[row] : until[row + 1]]
            p, w = p[p >= 0], w[p >= 0]
            common = row_of[p] >= 0
            total = np.zeros(len(ids))
            for i, x in zip(p[~common], w[~common], strict=True):
                total[at[ends[i] : ends[i + 1]]] += x * adds[ends[i] : ends[i + 1]]
            pick, total = finished(total, whole, tops, row_of[p[common]], w[common], lowest, k, stay)
            fit = stay[pick] & (total > 0) & (total >= lowest - 1e-9)
            pick, total = pick[fit], total[fit]
            if len(pick) > 4 * k:  # ties at the end stay in
                near = total >= np.partition(total, len(pick) - k)[len(pick) - k] - 1e-8
                pick, total = pick[near], total[near]
            first = np.lexsort((pick, -np.round(total, 9)))[:k]
            rows.append(np.full(len(first), row)), found.append(pick[first]), scores.append(total[first])
        if not rows:
            rows, found, scores = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        take = lambda values, which: values.take(pa.array(np.concatenate(which)))
        return pa.table({"query_id": take(queries, rows), "doc_id": take(ids, found), "score": np.concatenate(scores)})

    met = held.groupBy("block", "part").cogroup(wanted.groupBy("at", "of"))
    return met.applyInArrow(run, f"query_id {query_type}, doc_id {id_type}, score double")


def best(blocks: DataFrame, weights: DataFrame, queries: DataFrame, mean: float, k: int = 10, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The top k (query_id, doc_id, score, not yet ranked over all blocks) by the terms' weights (term, idf), and the pairs of blocks
    and queries that were scored for them. A query's repeated term counts as often. blocks is read three times: hand in a table.
    What is read more than once in between is kept in the shared folder."""
    spark, at = blocks.sparkSession, new_path(blocks.sparkSession)

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    asked = kept(weights.select("term", "idf").join(asked_terms(queries), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")), "asked")
    parts = queries.count() // QUERY_BLOCK + 1
    promised = kept(promises(blocks, asked, mean), "promised")
    foremost = promised.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "block"))).where("n = 1").drop("n")
    first = kept(foremost.withColumn("least", F.lit(0.0)), "first")
    early = kept(scored_pairs(blocks, first, asked, mean, k, parts, gone), "early")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"))
    reached = early.withColumn("n", F.row_number().over(by)).where(F.col("n") == k).select("query_id", F.col("score").alias("least"))
    rest = promised.join(first.select("query_id", F.col("block").alias("done")), "query_id").where("block <> done").join(reached, "query_id", "left")
    rest = kept(rest.withColumn("least", F.coalesce("least", F.lit(0.0))).where(F.col("most") >= F.col("least") - 1e-9).select("block", "query_id", "most", "least"), "rest")
    release(spark)
    rounds = -(-rest.count() // PAIRS)
    if rounds > 1:  # of the blocks, so that each is moved once
        late = None
        for i in range(rounds):
            found = kept(scored_pairs(blocks, rest.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == i), asked, mean, k, parts, gone), f"late{i}")
            late = found if late is None else late.unionByName(found)
            release(spark)
    else:
        late = scored_pairs(blocks, rest, asked, mean, k, parts, gone)
    return early.unionByName(late), first.select("block", "query_id").unionByName(rest.select("block", "query_id"))


def weighted(df: DataFrame, n_docs: int, floor: float = 0.25) -> DataFrame:
    """df (with term, df) with idf; a negative idf becomes a quarter of the mean idf."""
    raw = df.withColumn("raw", F.log(n_docs - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    idf: Column = F.when(F.col("raw") < 0, F.col("mean") * floor).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean)).withColumn("idf", idf).drop("raw", "mean")
