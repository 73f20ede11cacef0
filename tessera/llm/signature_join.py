"""Jaccard self-join of word-shingle sets by signature trees; links are reported as components.

1. Equal sets become one node. A set of s shingles is cut into parts by hash, more than two linked sets
   of its size class can differ in, so that linked sets agree in a whole part. Nodes that agree in a
   part are put into one cluster: each task joins the nodes of a key that it has itself into a star and
   passes on one node a key, so that a key of any number of nodes arrives as one row a task.
2. A cluster's nodes are dealt over blocks of like size, bounded in sets and in shingles. A block is a
   signature tree: its nodes hold OR-combined bitmaps of shingles and the range of set sizes. Block
   pairs, then tree node pairs, are dropped if the largest overlap that bitmaps and sizes allow is too
   small; what is left is compared exactly, unless already known to hang together. Large clusters go in
   rounds: within blocks, between neighbouring blocks, and then between the sets of any two blocks that share
   a part key which does not yet lie within one component, as many of them at a time as ROUND allows.
No link between different sets is lost; no step forms all pairs of a group of copies. Sets are made where they
meet: what moves are texts, compressed, which take a third of their shingles' room.

Nulls: a null or wordless text has an empty set and is linked with nothing. A null id gives a null
component unless linked rows have ids. Rows are the nodes: of repeated ids, each row is judged by its
own text. Very long texts make large sets, of which a block holds fewer. Columns beyond the id and the
text are ignored by link() and kept by keep_one(), whatever their names are. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import shingles
from .common import cut, few, release
from .components import components
from .packed import packed, unpack_text, unpacked

#: Sizes of a class lie within this factor of each other.
CLASS_RATIO = 1.4
#: Sets, and shingles, of a block at most (a single larger set is a block).
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
LEAF, FANOUT, SEEDS = 16, 4, 3
#: How often a round may move the texts of all large clusters, on average: what meets may grow faster than the table.
ROUND = 4
#: Part keys that a task gathers before it joins and passes them on; nodes that it remembers having met.
TASK_KEYS, TASK_NODES = 500_000, 250_000


class Parts:
    """The keys under which sets that may be linked meet."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]

    def differ(self, s: int) -> int:
        """The most shingles in which a set of at most s and a linked larger one differ."""
        larger = s * self.den // self.num
        return (s + larger) * (self.den - self.num) // (self.den + self.num)

    def classes(self, s: int) -> list[int]:
        while self.bounds[-1] <= s:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * CLASS_RATIO)))
        own = int(np.searchsorted(self.bounds, s, "right")) - 1
        found = [own]
        while own and self.bounds[own] * self.den > self.num * s:
            own -= 1
            found.append(own)
        return found

    def keys(self, members: np.ndarray) -> np.ndarray:
        """Of n parts, linked sets agree in n - differ at least: in a filled one, if one of them has fewer empty parts.

        A set with more empty parts is dealt out again under another seed, beside; under the last one,
        empty parts count as parts. Either both sets ask that far, or the one that stops has found enough."""
        out = []
        for c in self.classes(len(members)) if len(members) else ():
            most = self.differ(self.bounds[c + 1] - 1) if c + 1 < len(self.bounds) else 0
            if not most:  # linked sets of this class are equal
                continue
            n = most + most // 16 + int(most**0.5) // 2 + 1
            for seed in range(SEEDS):
                h = shingles.mix(members + np.uint64(seed * 7919 + 1))
                part = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                filled, start = np.unique(part[order], return_index=True)
                total = np.add.reduceat(members[order], start)
                enough = n - len(filled) < n - most
                if not enough and seed == SEEDS - 1:
                    every = np.zeros(n, np.uint64)
                    every[filled] = total
                    filled, total = np.arange(n), every
                label = np.uint64(c * SEEDS + seed + 1) * np.uint64(1 << 32) + filled.astype(np.uint64)
                out.append(shingles.mix(shingles.mix(label) + total))
                if enough:
                    break
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _own(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, body and ident, hashes of the text and of the id, and text."""
    return docs.select(F.col(doc).alias("doc_id"), _body(F.col(text)).alias("body"), _ident(F.col(doc)).alias("ident"), F.col(text).cast("string").alias("text"))


def _body(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _ident(doc: Column) -> Column:
    return F.xxhash64(F.lit(1), doc)


def _heads(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, body, ident, n, the set's size, and node, its number."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = shingles.WordHashes()
        for b in few(batches):
            size, node = [], []
            for text in b.column(3):
                members = shingles.shingle_set(shingles.word_hashes(text.as_py(), memo), width)
                size.append(len(members))
                node.append(_node(members))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(size, pa.int64()), pa.array(node, pa.int64())], names=["doc_id", "body", "ident", "n", "node"])

    return docs.mapInArrow(run, f"doc_id {doc_type}, body long, ident long, n long, node long")


def _node(members: np.ndarray) -> int | None:
    """A set's own number."""
    if not len(members):
        return None
    return int(shingles.mix(shingles.mix(members).sum(keepdims=True) + np.uint64(len(members))).view(np.int64)[0])


_KEYED = "key long, u long, v long"


def _keyed(key: np.ndarray, u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
    """Rows (key, u): u has the key; with v: an edge, the key of which is of no meaning."""
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(u), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v)], names=["key", "u", "v"])


def _part_keys(width: int, num: int, den: int):
    """Texts to one row a part key and lot of texts, and edges from its node to the others that have the key."""

    def joined(keys: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        node = np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
        key = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        yield _keyed(key[new], node[new], None)
        first = node[new][np.cumsum(new) - 1]
        pairs = np.unique(np.stack([first, node], axis=1)[first != node], axis=0)
        if len(pairs):
            yield _keyed(shingles.mix(pairs.astype(np.uint64).sum(axis=1)).view(np.int64), pairs[:, 0].copy(), pairs[:, 1].copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, parts = shingles.WordHashes(), Parts(num, den)
        met: set[int] = set()
        keys, nodes, held = [], [], 0
        for b in batches:
            for text in b.column(0):
                members = shingles.shingle_set(shingles.word_hashes(text.as_py(), memo), width)
                node = _node(members)
                if node is None or node in met:
                    continue
                if len(met) >= TASK_NODES:
                    met.clear()
                met.add(node)
                keys.append(parts.keys(members))
                nodes.append(node)
                held += len(keys[-1])
                if held >= TASK_KEYS:
                    yield from joined(keys, nodes)
                    keys, nodes, held = [], [], 0
        yield from joined(keys, nodes)

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, u), all of a key in one place: edges from each key's first node to its others."""
    key = first = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        edges = rows.filter(rows["v"].is_valid())
        yield from edges.select(["u", "v"]).to_batches()
        rows = rows.filter(rows["v"].is_null())
        if not rows.num_rows:
            continue
        k, v = rows["key"].to_numpy(), rows["u"].to_numpy()
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        new[0] = key is None or key != k[0]
        u = np.concatenate([[first if first is not None else v[0]], v[new]])[np.cumsum(new)]
        pick = u != v
        yield pa.RecordBatch.from_arrays([pa.array(u[pick]), pa.array(v[pick])], names=["u", "v"])
        key, first = int(k[-1]), int(u[-1])


def _clusters(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, root) for the nodes that share a part key with others."""
    keyed = docs.select("text").mapInArrow(_part_keys(width, num, den), _KEYED)
    return components(keyed.repartition("key").sortWithinPartitions("key", "u").mapInArrow(_stars, "u long, v long"))


class Tree:
    """Signature tree over sets ordered by size: levels of OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets], "i8")
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(maps, sets, strict=True):
            at = (s % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        self.sizes, self.maps = sizes, maps
        hidden = sizes - np.bitwise_count(maps).sum(1).astype("i8")  # shingles that share a bit with another
        level = (maps, sizes, sizes, hidden)
        self.levels = []
        step = LEAF
        while True:
            at = np.arange(0, len(level[1]), step)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)
            if len(at) == 1:
                break
            step = FANOUT


def _possible(a, i, b, j, num: int, den: int) -> bool:
    """May a set below node i and one below node j be linked?"""
    (or_a, least_a, most_a, hid_a), (or_b, least_b, most_b, hid_b) = a, b
    if most_a[i] * den < num * least_b[j] or most_b[j] * den < num * least_a[i]:
        return False
    overlap = min(int(np.bitwise_count(or_a[i] & or_b[j]).sum()) + int(max(hid_a[i], hid_b[j])), int(most_a[i]), int(most_b[j]))
    # linked: den * overlap >= num * union, and union = sizes - overlap
    return (den + num) * overlap >= num * int(least_a[i] + least_b[j])


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, roots: list, num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j) that join what roots (of left, then right) do not yet: a spanning forest of all links.

    right None: within left. Sets must come ordered by size."""
    sets = left + (right or [])
    shift = len(left) if right is not None else 0
    bits = 256
    while bits < 2 * max(map(len, sets), default=1):
        bits *= 2
    a = Tree(left, bits)
    b = a if right is None else Tree(right, bits)
    up = {r: r for r in roots}

    found: list[tuple[int, int]] = []

    def leaves(i: int, j: int) -> None:
        x0, y0 = i * LEAF, j * LEAF
        ma, mb = a.maps[x0 : x0 + LEAF], b.maps[y0 : y0 + LEAF]
        sa, sb = a.sizes[x0 : x0 + LEAF], b.sizes[y0 : y0 + LEAF]
        apart = np.bitwise_count(ma[:, None, :] ^ mb[None, :, :]).sum(2, dtype="i8")
        for x, y in np.argwhere(apart * (den + num) <= (den - num) * (sa[:, None] + sb[None, :])).tolist():
            p, q = x0 + x, shift + y0 + y
            if (right is None and p >= q) or (rp := _root(up, roots[p])) == (rq := _root(up, roots[q])):
                continue
            both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if den * both >= num * (len(sets[p]) + len(sets[q]) - both):
                up[max(rp, rq)] = min(rp, rq)
                found.append((p, q))

    la, lb = len(a.levels) - 1, len(b.levels) - 1
    stack = [(la, 0, lb, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if (right is None and la == lb and i > j) or not _possible([*a.levels[la]], i, [*b.levels[lb]], j, num, den):
            continue
        if la == lb == 0:
            leaves(i, j)
            continue
        inner = [(la - 1, x) for x in range(i * FANOUT, min((i + 1) * FANOUT, len(a.levels[la - 1][1])))] if la >= lb and la else [(la, i)]
        other = [(lb - 1, y) for y in range(j * FANOUT, min((j + 1) * FANOUT, len(b.levels[lb - 1][1])))] if lb >= la and lb else [(lb, j)]
        stack += [(*x, *y) for x in inner for y in other]
    return found


def _set_of(packed: bytes, width: int, memo: shingles.WordHashes) -> np.ndarray:
    return shingles.shingle_set(shingles.word_hashes(unpack_text(packed), memo), width)


def _block_links(width: int, num: int, den: int):
    """A block, or two, to edges that join each root with the least one that its links reach."""
    memo = shingles.WordHashes()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "n", "node"], kind="stable")
        roots, sets = frame.root.tolist(), [_set_of(x, width, memo) for x in frame.text]
        n_left = int((frame.side == 0).sum())
        links = tree_links(sets[:n_left], sets[n_left:] if n_left < len(sets) else None, roots, num, den) if n_left else []
        up = {r: r for r in roots}
        for i, j in links:
            a, b = _root(up, roots[i]), _root(up, roots[j])
            up[max(a, b)] = min(a, b)
        return pd.DataFrame([(r, top) for r in up if (top := _root(up, r)) != r], columns=["u", "v"]).astype("i8")

    return run


def _root(up: dict[int, int], r: int) -> int:
    while up[r] != r:
        up[r] = r = up[up[r]]
    return r


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, which names a row of docs by body and ident, with the row's text, compressed."""
    columns = [c for c in wanted.columns if c not in ("body", "ident")]
    texts = packed(docs.select(F.col("body").alias("text_body"), F.col("ident").alias("text_ident"), "text").where("text IS NOT NULL"), "text")
    met = texts.join(wanted, (F.col("text_body") == F.col("body")) & (F.col("text_ident") == F.col("ident")))
    # Rows alike in id and text are one.
    return met.groupBy("text_body", "text_ident").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in columns)).select(*columns, "text")


def _blocks(wanted: DataFrame, num: int, den: int) -> DataFrame:
    """wanted (cluster, node, n) with small, band and sub: a cluster of a single block is joined as a whole, else bands of sizes make the blocks."""
    ratio = float(np.log(den / num)) if num < den else 1.0
    banded = wanted.withColumn("band", F.floor(F.log("n") / ratio).cast("long"))
    sizes = banded.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("band_sets"), F.sum("n").alias("band_n"))
    whole = sizes.groupBy("cluster").agg(((F.sum("band_sets") <= BLOCK) & (F.sum("band_n") <= BLOCK_SHINGLES)).alias("small"))
    subs = F.greatest(F.ceil(F.col("band_sets") / BLOCK), F.ceil(F.col("band_n") / BLOCK_SHINGLES))
    dealt = banded.join(sizes, ["cluster", "band"]).join(whole, "cluster").withColumn("sub", F.pmod(F.xxhash64("node"), subs))
    return dealt.select("cluster", "node", "n", "small", *(F.when(F.col("small"), 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("band", "sub")), "body", "ident")


def _link_clusters(blocked: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, root) of every node with a link. blocked, a written table: cluster, node, n, small, band, sub, text."""
    join, spark = _block_links(width, num, den), blocked.sparkSession
    own = blocked.withColumn("root", F.col("node")).withColumn("side", F.lit(0))
    # Stars within blocks: of clusters of one block these are the components.
    roots = components(own.groupBy("cluster", "band", "sub").applyInPandas(join, "u long, v long"))
    large = blocked.where(~F.col("small"))
    blocks = cut(large.groupBy("cluster", "band", "sub").agg(F.count(F.lit(1)).alias("k")))
    if blocks.isEmpty():
        return roots
    left = blocks.select("cluster", F.col("band").alias("b1"), F.col("sub").alias("s1"))
    right = blocks.select(F.col("cluster").alias("c2"), F.col("band").alias("b2"), F.col("sub").alias("s2"))
    # Neighbours first, within a band and from band to band: one set of each component there is so far stands for it, which
    # joins what large groups of copies have in several blocks.
    near = (F.col("s1") + 1 == F.col("s2")) & (F.col("b1") == F.col("b2")) | (F.col("b2") == F.col("b1") + 1) & (F.col("s1") == 0) & (F.col("s2") == 0)
    chained = left.join(right, (F.col("cluster") == F.col("c2")) & near).drop("c2")
    now = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stand = now.groupBy("cluster", "band", "sub", "root").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c > 1").drop("c")
    sides = chained.select("*", F.col("b1").alias("band"), F.col("s1").alias("sub"), F.lit(0).alias("side")).union(chained.select("*", F.col("b2").alias("band"), F.col("s2").alias("sub"), F.lit(1).alias("side")))
    by = ["cluster", "b1", "s1", "b2", "s2"]

    def joined(met: DataFrame) -> DataFrame:
        more = met.groupBy(*by).applyInPandas(join, "u long, v long")
        found = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
        release(spark)
        return found

    roots = joined(sides.join(stand, ["cluster", "band", "sub"]).join(large.select("node", "n", "text"), "node"))
    now = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sharing = cut(_sharing(now, width, num, den))
    release(spark)
    moved, held = (t.agg(F.sum("n")).first()[0] or 0 for t in (sharing, large))
    rounds = int(-(-moved // (ROUND * held)))
    for i in range(rounds):
        now = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = joined(sharing.where(F.pmod(F.xxhash64(*by), F.lit(rounds)) == i).drop("n").join(now.select("node", "n", "text", "root"), "node"))
    return roots


def _sharing(now: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(cluster, b1, s1, b2, s2, side, node, n): which nodes of two blocks have to meet. now: cluster, band, sub, node, n, root, text.

    Linked sets share a part key, so that a node meets the blocks that hold others with one of its keys, and of keys
    alone that join what is not yet one component. Clusters hang together by chains of keys: most of their
    block pairs have few such nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, memo = Parts(num, den), shingles.WordHashes()
        for b in few(batches, 256):
            keys = [parts.keys(_set_of(x, width, memo)) for x in b.column(6).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), list(map(len, keys))))
            every = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every), *(b.column(i).take(at) for i in range(6))], names=["key", "cluster", "band", "sub", "node", "n", "root"])

    keyed = now.select("cluster", "band", "sub", "node", "n", "root", "text").mapInArrow(run, "key long, cluster long, band long, sub long, node long, n long, root long")
    of_key = Window.partitionBy("cluster", "key")  # one shuffle: most keys are one node's, and end here
    some = cut(keyed.withColumn("lo", F.min("root").over(of_key)).withColumn("hi", F.max("root").over(of_key)).where("lo <> hi").drop("root", "lo", "hi"))
    there = some.select(F.col("cluster").alias("c"), F.col("key").alias("k"), F.col("band").alias("other_band"), F.col("sub").alias("other_sub")).distinct()
    met = some.join(there, (F.col("cluster") == F.col("c")) & (F.col("key") == F.col("k")))
    first = (F.col("band") < F.col("other_band")) | (F.col("band") == F.col("other_band")) & (F.col("sub") < F.col("other_sub"))
    met = met.where((F.abs(F.col("band") - F.col("other_band")) <= 1) & ((F.col("band") != F.col("other_band")) | (F.col("sub") != F.col("other_sub"))))
    place = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return met.select("cluster", place("band", "other_band").alias("b1"), place("sub", "other_sub").alias("s1"), place("other_band", "band").alias("b2"), place("other_sub", "sub").alias("s2"), F.when(first, 0).otherwise(1).alias("side"), "node", "n").distinct()


def link(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links of Jaccard >= num / den reach. body: a hash of the text."""
    return _linked(docs, doc, text, width, num, den).drop("root", "ident")


def _linked(docs: DataFrame, doc: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """link's columns, ident and root, the component's least node, which tells components apart whatever the ids are."""
    own = _own(docs, doc, text)
    heads = cut(_heads(own, width))
    some = heads.where("n > 0")
    clusters = _clusters(own, width, num, den)
    release(docs.sparkSession)
    nodes = some.groupBy("node").agg(F.min(F.struct("doc_id", "ident", "body")).alias("x"), F.first("n").alias("n")).select(F.col("node").alias("own_node"), "n", F.col("x.doc_id").alias("least"), "x.ident", "x.body")
    wanted = nodes.join(clusters.withColumnRenamed("root", "cluster"), F.col("own_node") == F.col("node")).select("cluster", "node", "n", "body", "ident")
    blocked = cut(_texts(own, _blocks(cut(wanted), num, den)))
    release(docs.sparkSession)
    roots = _link_clusters(blocked, width, num, den)
    placed = nodes.join(roots, F.col("own_node") == F.col("node"), "left").select("own_node", "least", F.coalesce("root", "own_node").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.select("own_node", "root").join(least, "root")
    return heads.join(placed, F.col("node") == F.col("own_node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "body", "ident", "root")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without all but one document of each component: that of the smallest id stays (a null id is the last), of the smallest hash among texts of that id.

    Documents without words stay, each row of them; of other rows alike in id and text, one stays."""
    found = cut(_linked(docs, doc, text, width, num, den))
    release(docs.sparkSession)
    empty = found.where("n_shingles = 0").select("ident", "body").distinct()
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body", "ident")).alias("x")).select("x.ident", "x.body")
    chosen = empty.select("*", F.lit(True).alias("every")).union(first.select("*", F.lit(False).alias("every")))
    # The user's columns go by number here, so that none can clash.
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc, text = names[docs.columns.index(doc)], names[docs.columns.index(text)]
    moved = rows.select(*names, _ident(F.col(doc)).alias("row_ident"), _body(F.col(text)).alias("row_body"))
    moved = packed(moved, text) if docs.schema[names.index(text)].dataType == T.StringType() else moved
    met = moved.join(chosen, (F.col("row_ident") == F.col("ident")) & (F.col("row_body") == F.col("body")))
    each = Window.partitionBy("row_ident", "row_body").orderBy(F.xxhash64(*[c for c in names if c != text]))
    kept = met.withColumn("nth", F.when(F.col("every"), 1).otherwise(F.row_number().over(each))).where("nth = 1").select(names)
    return (unpacked(kept, text) if dict(kept.dtypes)[text] == "binary" else kept).toDF(*docs.columns)
