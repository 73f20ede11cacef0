"""Nearest neighbours by an inverted multi-index.

Two halves of each vector are quantised apart, so that K centroids each make K * K cells; K grows with
the table. For a query, centroid pairs are visited by their summed distance, in a heap over the two
sorted lists, until the cells visited hold enough entries; those are reranked by the exact inner product.
How many are enough is measured: for PROBES of the queries the true neighbours are found in one pass over
all rows, and the depth is what the wanted recall of those takes. Where vectors lie in clusters, that is a
small share of the table; where nothing tells them apart, much of it.

Cells are put together to shards of about SHARD_ROWS entries, larger cells are dealt over several. A
shard's entries are copied once for each QUERY_ROWS queries that visit it, so that what meets in one task
is bounded on both sides. What is held in one place besides: the sample, the centroids and the cells'
counts, which SAMPLE and CENTROIDS bound.

Vectors that are null, zero, or hold null or non-finite components take no part; all others do, of
whatever dimension: missing components count as zeros. Rows of the query's own id are not its
candidates; of query rows with one id, the least is asked; rows of one other id are candidates each. Ties go to the smaller id. Columns beyond the
id and the vector are ignored, whatever their names are; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, hash_sample

#: Rows that the centroids are fitted on, at most: an even share by hashed id and vector.
SAMPLE = 20_000
SHARD_ROWS, QUERY_ROWS = 8192, 4096
#: Centroids of a half at most; queries that the depth is measured on.
CENTROIDS, PROBES = 512, 128


def usable(vectors: DataFrame, vec: str, embedding: str) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(vec).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from rows chosen by a fixed seed."""
    centers = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = assign(x, centers)
        total = np.zeros_like(centers)
        np.add.at(total, of, x)
        n = np.bincount(of, minlength=k)
        centers[n > 0] = total[n > 0] / n[n > 0, None]
    return centers


def assign(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)


def visit(near1: np.ndarray, near2: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells by falling summed nearness of their two centroids, until they hold `wanted` entries."""
    order1, order2 = np.argsort(-near1, kind="stable"), np.argsort(-near2, kind="stable")
    a, b, k = near1[order1].tolist(), near2[order2].tolist(), len(near2)
    heap, cells, held, reached = [(-a[0] - b[0], 0, 0)], [], 0, {(0, 0)}
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(order1[i]) * k + int(order2[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < k and (x, y) not in reached:
                reached.add((x, y))
                heapq.heappush(heap, (-a[x] - b[y], x, y))
    return cells


def shards_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first shard and its number of shards."""
    parts = -(-counts // SHARD_ROWS)
    first, at, room = np.zeros(len(counts), "i8"), -1, 0
    for cell in np.flatnonzero(counts):
        if parts[cell] > 1:
            at += 1
            first[cell] = at
            at, room = at + int(parts[cell]) - 1, 0
        else:
            if counts[cell] > room:
                at, room = at + 1, SHARD_ROWS
            first[cell] = at
            room -= int(counts[cell])
    return first, parts


def matrix(vectors, width: int | None = None) -> np.ndarray:
    """Rows of one width (the longest's), missing components being zeros and further ones left out."""
    rows = [np.asarray(v, float) for v in vectors]
    width = max(map(len, rows), default=0) if width is None else width
    if all(len(r) == width for r in rows):
        return np.array(rows).reshape(-1, width)
    out = np.zeros((len(rows), width))
    for r, v in zip(out, rows, strict=True):
        n = min(width, len(v))
        r[:n] = v[:n]
    return out


def best(near: np.ndarray, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the `top` nearest entries. near: products as a matrix product rounds them, -inf where closed."""
    least = np.partition(near, len(near) - top)[len(near) - top] if len(near) > top else -np.inf
    # Matrix products round by their place in the matrix: near ties are decided on plain sums.
    pick = np.flatnonzero((near >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else True) & np.isfinite(near))
    exact = np.zeros(len(pick))
    for d in range(len(q)):
        exact += q[d] * vectors[pick, d]
    order = np.lexsort((ids[pick], -exact))[:top]
    return pick[order], exact[order]


_FOUND = {"query_id": "i8", "vec_id": "i8", "score": "f8"}


def rerank(entries: pd.DataFrame, asked: pd.DataFrame, top: int, books: tuple[np.ndarray, np.ndarray], dim: int) -> pd.DataFrame:
    """The best `top` of a shard's entries for each of its queries, over the cells that the query visits."""
    out = [pd.DataFrame({c: pd.Series(dtype=t) for c, t in _FOUND.items()})]
    if len(entries) and len(asked):
        entries = entries.sort_values("vec_id", kind="stable")
        ids, cell = entries.vec_id.to_numpy(), entries.cell.to_numpy()
        width = max(entries.v.map(len).max(), asked.v.map(len).max())
        vectors, k, half = matrix(entries.v, width), len(books[1]), dim // 2
        for at in range(0, len(asked), 256):
            block = asked.iloc[at : at + 256]
            queries, coarse = matrix(block.v, width), matrix(block.v, dim)
            near = queries @ vectors.T
            opened = (coarse[:, :half] @ books[0].T)[:, cell // k] + (coarse[:, half:] @ books[1].T)[:, cell % k]
            near[opened < block.depth.to_numpy()[:, None]] = -np.inf
            near[block.query_id.to_numpy()[:, None] == ids[None, :]] = -np.inf
            for r, (query, q) in enumerate(zip(block.query_id, queries, strict=True)):
                pick, exact = best(near[r], vectors, ids, q, top)
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[pick], "score": exact}))
    return pd.concat(out).astype(_FOUND)


def true_neighbours(entries: DataFrame, queries: list, top: int) -> dict[int, list[int]]:
    """Per query (vec_id, v), the cells of its nearest entries, by one pass over all; a task sends `top` a query."""
    ask = entries.sparkSession.sparkContext.broadcast(([q for q, _ in queries], [v for _, v in queries]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, vectors = ask.value
        held = pd.DataFrame({"query_id": pd.Series(dtype="i8"), "cell": pd.Series(dtype="i8"), "score": pd.Series(dtype="f8")})
        for f in frames:
            if not len(f):
                continue
            width = max(f.v.map(len).max(), max(map(len, vectors)))
            near = matrix(vectors, width) @ matrix(f.v, width).T
            near[np.array(own)[:, None] == f.vec_id.to_numpy()[None, :]] = -np.inf
            n = min(top, near.shape[1])
            at = np.argpartition(-near, n - 1, axis=1)[:, :n]
            new = pd.DataFrame({"query_id": np.repeat(own, n), "cell": f.cell.to_numpy()[at].ravel(), "score": np.take_along_axis(near, at, 1).ravel()})
            held = pd.concat([held, new[np.isfinite(new.score)]]).sort_values("score", ascending=False, kind="stable").groupby("query_id").head(top)
        yield held.astype({"query_id": "i8", "cell": "i8", "score": "f8"})

    found = entries.mapInPandas(run, "query_id long, cell long, score double").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cell"))).where(F.col("nth") <= top)
    out: dict[int, list[int]] = {}
    for r in found.select("query_id", "cell").collect():  # PROBES * top rows at most
        out.setdefault(r["query_id"], []).append(r["cell"])
    return out


def depth(books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, queries: list, true: dict[int, list[int]], dim: int, recall: float) -> int:
    """The entries that a query has to visit for the wanted share of the true neighbours to be among them."""
    needed = []
    for query, v in queries:
        v = matrix([v], dim)[0]
        near = (books[0] @ v[: dim // 2])[:, None] + (books[1] @ v[dim // 2 :])[None, :]
        order = np.argsort(-near.ravel(), kind="stable")
        reached = np.empty(len(order), "i8")
        reached[order] = np.cumsum(counts[order])
        needed += reached[true.get(query, [])].tolist()
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if needed else 1


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, vec: str = "vec_id", embedding: str = "embedding", centroids: int | None = None, recall: float = 0.94) -> DataFrame:
    """query_id, rank, vec_id, score. centroids: K, by default a quarter of the rows' root; recall: what the measured depth aims at."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec, embedding)
    n = rows.count()
    # Equal rows have equal hashes and are drawn together or not at all; the limit bounds what comes here in any case.
    drawn = hash_sample(rows, n, SAMPLE, "vec_id", "v").select("h", "vec_id", "v").limit(SAMPLE).collect() or rows.select(F.lit(0).alias("h"), "vec_id", "v").limit(SAMPLE).collect()
    sample = [r["v"] for r in sorted(drawn, key=lambda r: (r["h"], r["vec_id"], r["v"]))] or [[0.0, 0.0]]
    # Cells are told apart by as many components as most vectors of the sample have.
    dim = int(pd.Series([len(x) for x in sample]).mode().iloc[0])
    sample, half = matrix(sample, dim), dim // 2
    k = max(1, min(centroids or max(16, min(CENTROIDS, int(n**0.5 / 4))), len(sample)))
    books = tuple(kmeans(x, k) if x.shape[1] else np.zeros((1, 0)) for x in (sample[:, :half], sample[:, half:]))
    k2 = len(books[1])
    held = spark.sparkContext.broadcast(books)

    def quantise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = matrix(f.v, dim)
            yield f.assign(cell=assign(x[:, :half], held.value[0]) * k2 + assign(x[:, half:], held.value[1]))

    entries = cut(rows.mapInPandas(quantise, "vec_id long, v array<double>, cell long"))
    counts = np.zeros(len(books[0]) * k2, "i8")
    for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # K * K rows at most
        counts[r["cell"]] = r["n"]
    asked = usable(queries, vec, embedding).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = cut(asked)
    n_asked = asked.count()
    some = [(r["query_id"], r["v"]) for r in sorted(hash_sample(asked, n_asked, PROBES, "query_id").collect(), key=lambda r: r["h"])[: 2 * PROBES]]
    wanted = depth(books, counts, some, true_neighbours(entries, some, top), dim, recall) if some else 1
    first, parts = shards_of(counts)
    index = spark.sparkContext.broadcast((counts, first, parts, max(wanted, top)))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, first, parts, wanted = index.value
        (one, two), last = held.value, first + np.maximum(parts, 1)
        for f in frames:
            made = []
            for query, v in zip(f.query_id, f.v, strict=True):
                x = matrix([v], dim)[0]
                near1, near2 = one @ x[:half], two @ x[half:]
                cells = visit(near1, near2, counts, wanted)
                if cells:
                    least = float((near1[np.array(cells) // k2] + near2[np.array(cells) % k2]).min())
                    shards = {s for c in cells for s in range(int(first[c]), int(last[c]))}
                    made += [(query, v, least - 1e-9 * (1 + abs(least)), s) for s in sorted(shards)]
            yield pd.DataFrame(made, columns=["query_id", "v", "depth", "shard"])

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, first, parts, _ = index.value
        for f in frames:
            cell = f.cell.to_numpy()
            # Rows of one id are spread as well, by their place in the batch.
            yield f.assign(shard=first[cell] + (f.vec_id.to_numpy() + np.arange(len(f))) % np.maximum(parts[cell], 1))

    tasks = max(1, min(-(-n_asked // 64), 4 * spark.sparkContext.defaultParallelism + n_asked // 4096))
    probes = cut(asked.repartition(tasks, "query_id").mapInPandas(probe, "query_id long, v array<double>, depth double, shard long"))
    load = cut(probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("blocks")))
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block")
    probes = probes.join(load, "shard").select("shard", block, "query_id", "v", "depth")
    dealt = entries.mapInPandas(deal, "vec_id long, v array<double>, cell long, shard long").join(load, "shard")
    dealt = dealt.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "vec_id", "v", "cell")
    met = dealt.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block")).applyInPandas(lambda e, q: rerank(e, q, top, held.value, dim), "query_id long, vec_id long, score double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
