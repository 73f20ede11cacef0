"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so that the instance is a histogram of at most `capacity`
counts, however many documents there are. The driver plans on that histogram: small sets that dominate
every other set with the same item are fixed for good, the rest is packed best-fit decreasing, both for
whole counts at a time. The plan has a bounded number of runs (a length, a range of ranks, where they
go); each document finds its place by its rank among the documents of its length, which Spark counts
from per-bucket counts and ranks within buckets. No task sees all documents of a length.

Nulls: a null text is empty and has just the end id; a null doc_id stays. Repeated rows are packed each,
and ties among documents of one length are settled by the row's number. Very long texts are cut into
pieces whole. Columns beyond the id and the text are ignored, whatever their names are; an empty table
gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import cut

#: Rows of one length that a rank window sorts at a time.
BUCKET_ROWS = 100_000


def pieces(docs: DataFrame, doc: str, text: str, ranks_path: str, added: tuple, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): texts of over `capacity` ids are cut, the first piece taking the remainder."""
    end = int(end_id).to_bytes(4, "little")
    doc_type = docs.schema[doc].dataType
    schema = f"doc_id {doc_type.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.id_bytes(ranks_path, added)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = memoryview(encode(t.as_py() or "") + end)
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _largest(counts: np.ndarray, most: int) -> int:
    """The largest length of at most `most` that is left, or 0."""
    left = np.flatnonzero(counts[: max(most, 0) + 1])
    return int(left[-1]) if len(left) else 0


def _smallest(counts: np.ndarray, n: int) -> list[int]:
    found: list[int] = []
    for length in np.flatnonzero(counts):
        found += [int(length)] * min(n - len(found), int(counts[length]))
        if len(found) == n:
            break
    return found


def _dominating(counts: np.ndarray, w: int, capacity: int) -> list[int] | None:
    """Partners of w in a set that dominates every feasible set with w, or None.

    A set dominates another if the other's items, w apart, can be shared out among this one's so that
    none gets more than its own length; exchanging them then keeps a solution's number of sequences."""
    gap = capacity - w
    counts = counts.copy()
    counts[w] -= 1
    b = _largest(counts, gap)
    if not b:
        return []
    least = _smallest(counts, 3)
    if b == gap or len(least) < 2 or least[0] + least[1] > gap:
        return [b]
    if len(least) == 3 and sum(least) <= gap:
        return None
    # At most two partners fit. The largest that can be the smaller one of two, and the best sum of two:
    lengths = [int(x) for x in np.flatnonzero(counts[: gap + 1])]
    best, inner = 0, 0
    for low in lengths:
        counts[low] -= 1
        high = _largest(counts, gap - low)
        counts[low] += 1
        if high:
            best = max(best, low + high)
            inner = max(inner, min(low, high))
    if b >= best:
        return [b]
    counts[b] -= 1
    second = _largest(counts, gap - b)
    return [b, second] if second and inner <= second else None


def reduce(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Fix dominating sets until none is left to find; counts keeps the rest. Returns (lengths, times)."""
    fixed: list[tuple[list[int], int]] = []
    again = True
    while again:
        again = False
        for w in np.flatnonzero(counts)[::-1]:
            w = int(w)
            while counts[w]:
                partners = _dominating(counts, w, capacity)
                if partners is None:
                    break
                need = np.bincount([w, *partners], minlength=len(counts))
                # Repeat while the argument holds as it stands. For a full set, a lone item or a pair it does to the
                # end; for others it looks at which lengths are there, up to three of each besides, so that it
                # holds while more than those are left of the lengths that the set takes.
                spare = 0 if len(partners) < 2 or w + sum(partners) == capacity else 4
                times = max(1, int(((counts[need > 0] - spare) // need[need > 0]).min()))
                counts -= need * times
                fixed.append(([w, *partners], times))
                again = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts: sequences alike in filling are handled together."""
    open_bins: dict[int, list[list]] = {}  # room -> [[lengths], times]
    done: list[tuple[list[int], int]] = []

    def put(room: int, lengths: list[int], times: int) -> None:
        if times:
            if room:
                open_bins.setdefault(room, []).append([lengths, times])
            else:
                done.append((lengths, times))

    for w in np.flatnonzero(counts)[::-1]:
        w, left = int(w), int(counts[w])
        for room in sorted(r for r in open_bins if r >= w):
            per = room // w  # a sequence that took one stays the best fit while it has room
            groups, open_bins[room] = open_bins[room], []
            for k, (lengths, times) in enumerate(groups):
                full = min(times, left // per)
                put(room - per * w, lengths + [w] * per, full)
                left -= full * per
                rest = times - full
                if rest and left:
                    put(room - left * w, lengths + [w] * left, 1)
                    rest, left = rest - 1, 0
                if rest:
                    open_bins[room].append([lengths, rest])
                if not left:
                    open_bins[room] += groups[k + 1 :]
                    break
            if not open_bins[room]:
                del open_bins[room]
            if not left:
                break
        if left:
            per = capacity // w
            put(capacity - per * w, [w] * per, left // per)
            if left % per:
                put(capacity - left % per * w, [w] * (left % per), 1)
    return done + [(lengths, times) for groups in open_bins.values() for lengths, times in groups]


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset), sorted; ranks count from 0 by length."""
    counts = np.zeros(capacity + 1, "i8")
    for length, n in histogram.items():
        counts[length] = n
    rows, used, sequence = [], np.zeros(capacity + 1, "i8"), 0
    for lengths, times in [*reduce(counts, capacity), *best_fit(counts, capacity)]:
        at = 0
        for length, copies in zip(*np.unique(lengths, return_counts=True), strict=True):
            rows.append((length, used[length], copies, sequence, at))
            used[length] += copies * times
            at += length * copies
        sequence += times
    return np.array(sorted(rows), "i8").reshape(-1, 5)


def pack(sized: DataFrame, capacity: int) -> DataFrame:
    """sized (with length, 1 to capacity) with sequence_id and offset. sized is read more than once: hand in a written table."""
    histogram = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    placed = plan(histogram, capacity)
    buckets = sum(histogram.values()) // BUCKET_ROWS + 1
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_id")) - 1)
    ranked = ranked.join(sums, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before", "row_id")
    plan_rows = sized.sparkSession.sparkContext.broadcast(placed)
    kept = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan_rows.value
        # (length, rank) as one number; ranks stay far below the factor's 2**50
        keys = p[:, 0] * 2**50 + p[:, 1]
        for b in batches:
            b = pa.Table.from_batches([b])
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            run = p[np.searchsorted(keys, length * 2**50 + rank, "right") - 1] if len(length) else p[:0]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 3] + nth // run[:, 2], run[:, 4] + nth % run[:, 2] * length
            for out in b.select(kept).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches():
                yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", ranks_path: str | None = None, json_path: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    json_path: the tokenizer whose added tokens count; ranks_path: the same vocabulary as ranks."""
    added = tokens.added_tokens(json_path or tokens.default_path("byte_bpe_50k.json"))
    made = pieces(docs, doc, text, ranks_path or tokens.default_path("byte_bpe_50k.tiktoken"), added, capacity, end_id)
    sized = cut(made.withColumn("row_id", F.monotonically_increasing_id()))
    return pack(sized, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
