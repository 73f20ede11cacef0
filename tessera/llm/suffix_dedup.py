"""Repeated passages by a sparse suffix array.

Of all suffixes of a text, those are kept that begin at a minimiser: the least hash of eight words among
43 neighbours. Two texts that share 50 words share the 43 hashes in them, and so keep the same suffix.
Suffixes whose first eight words stand nowhere else are dropped; the others get their words to the left
and right from the text again, are sorted by what follows, then by what precedes, and each is compared
with its neighbours, extending matches both ways. Matches of at least min_words are reported,
overlapping ones as one span.

Two texts may agree in min_words around a place and yet stand far apart, if more than NEAR others agree
with what follows it. So where a run of suffixes that agree in what follows is longer than NEAR, each
window of min_words around them that the neighbours do not account for is hashed as a whole, and with
them one of each that they do; the hashes are sorted, and windows that stand twice are reported. Thereby
the spans are whole: every word of every window of min_words that stands twice lies in one.

A range of the sorted order needs no more than its own rows; what lies at the seams of two ranges is
compared apart, a few rows per range. A passage of any number of documents spreads over many ranges.

Nulls: a null text has no words; a null id is an id. Of repeated rows, each reports the other (with its
own id as other_doc_id). Very long texts have more suffixes, no longer ones. Columns beyond the id and
the text are ignored, whatever their names are; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shingles
from .common import cut
from .packed import packed as packed_texts
from .packed import unpack_text

GRAM = 8
#: Neighbours on either side that a suffix is compared with; windows are hashed beyond them.
NEAR = 4
PACKED = 20
#: A null id among numbers.
NULL = -(2**63)


def minimisers(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the least hash, leftmost of equal ones, of every `window` neighbours; how far before it
    the first and the last of those windows begin."""
    if len(hashes) < window:
        return (np.empty(0, np.int64),) * 3
    least = np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(axis=1)
    at, first, n = np.unique(least + np.arange(len(least)), return_index=True, return_counts=True)
    return at, at - first, at - (first + n - 1)


def suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """(gram, doc_id, body, pos) of every kept suffix; body, a hash of the text, tells rows of one id apart.

    Below pos' PACKED bits stand how far before it its windows begin, at most and at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = shingles.WordHashes()
        for b in batches:
            grams, pos, row = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
            for i, text in enumerate(b.column(2)):
                h = shingles.grams(shingles.word_hashes(text.as_py(), memo), GRAM)
                at, most, least = minimisers(h, min_words - GRAM + 1)
                grams.append(h[at])
                pos.append((at << PACKED) + (most << PACKED // 2) + least)
                row += [i] * len(at)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(pos))], names=["gram", "doc_id", "body", "pos"])

    return docs.mapInArrow(run, "gram long, doc_id long, body long, pos long")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range, the rows whose gram a neighbour has; a range's first and last rows stay in any case."""
    held, held_stays = None, True
    for b in batches:
        rows = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        n = rows.num_rows
        if not n:
            continue
        g = rows["gram"].to_numpy()
        stays = np.zeros(n, bool)
        stays[0] = held_stays
        stays[1:] |= g[1:] == g[:-1]
        stays[:-1] |= g[1:] == g[:-1]
        yield from rows.slice(0, n - 1).filter(pa.array(stays[:-1])).select(["doc_id", "body", "pos"]).to_batches()
        held, held_stays = rows.slice(n - 1).to_batches()[0], bool(stays[-1])
    if held is not None:
        yield held.select(["doc_id", "body", "pos"])


def contexts(docs: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """(ahead, behind, doc_id, body, pos, most, least): 32-bit word hashes from the place on, and backwards before it."""
    width = min_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = shingles.WordHashes()
        for b in batches:
            ahead, behind, row, packed = [], [], [], []
            for i, (text, places) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                words = np.maximum((shingles.word_hashes(unpack_text(text.as_py()), memo) >> np.uint64(32)).astype("u4"), 1)
                padded = np.concatenate([np.zeros(width, "u4"), words, np.zeros(width, "u4")])
                back = padded[::-1]
                for place in places.as_py():
                    p = place >> PACKED
                    ahead.append(padded[width + p : 2 * width + p].tobytes())
                    at = len(padded) - width - p
                    behind.append(back[at : at + width].tobytes())
                    row.append(i)
                    packed.append(place)
                if len(row) > 2048:
                    yield out(b, ahead, behind, row, packed)
                    ahead, behind, row, packed = [], [], [], []
            yield out(b, ahead, behind, row, packed)

    def out(b, ahead, behind, row, packed) -> pa.RecordBatch:
        rows, at, half = pa.array(row, pa.int64()), np.array(packed, np.int64), PACKED // 2
        ints = [pa.array(x.astype("i4")) for x in (at >> PACKED, (at >> half) & ((1 << half) - 1), at & ((1 << half) - 1))]
        return pa.RecordBatch.from_arrays([pa.array(ahead, pa.binary()), pa.array(behind, pa.binary()), b.column(0).take(rows), b.column(1).take(rows), *ints], names=["ahead", "behind", "doc_id", "body", "pos", "most", "least"])

    listed = places.groupBy(F.col("doc_id").alias("d"), F.col("body").alias("t")).agg(F.collect_set("pos").alias("places"))
    texts = packed_texts(docs.where("text IS NOT NULL"), "text")
    met = texts.join(listed, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["body"] == F.col("t")))
    return met.select("doc_id", "body", "text", "places").mapInArrow(run, "ahead binary, behind binary, doc_id long, body long, pos int, most int, least int")


#: A repeat has start, end and other; a row at a range's seam has pos; a window has start, key and check, its hashes.
_FOUND = "doc_id long, body long, start int, end int, other long, ahead binary, behind binary, pos int, most int, least int, key long, check int"
_FOUND_TYPES = {f.split()[0]: {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in _FOUND.split(", ")}


def _found_rows(**columns) -> pa.RecordBatch:
    """A batch of _FOUND; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if isinstance(columns.get(c), np.ndarray) else columns.get(c, pa.nulls(n, t)) for c, t in _FOUND_TYPES.items()], names=list(_FOUND_TYPES))


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _window_hashes(ahead: np.ndarray, behind: np.ndarray, row: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
    """Per (row, back), two hashes of as many words as ahead has, from `back` words before the place on."""
    width = ahead.shape[1]
    words = shingles.mix(np.concatenate([behind[:, ::-1], ahead], axis=1).astype(np.uint64))
    out = []
    for base in _BASES:
        inverse = pow(base, -1, 1 << 64)
        powers, undone = (np.array([pow(x, i, 1 << 64) for i in range(2 * width + 1)], np.uint64) for x in (base, inverse))
        sums = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(words * powers[:-1], axis=1, dtype=np.uint64)], axis=1)
        at = width - back
        out.append(shingles.mix((sums[row, at + width] - sums[row, at]) * undone[at]))
    return out


def _reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row, how many words agree before the first that does not; padding agrees with nothing."""
    differ = np.concatenate([(a != b) | (a == 0), np.ones((len(a), 1), bool)], axis=1)
    return differ.argmax(axis=1)


def _extend(min_words: int):
    """Over one sorted range of suffixes: what the neighbours share, windows to be looked up, rows at the seams."""
    width = min_words
    names = ["ahead", "behind", "doc_id", "body", "pos", "most", "least"]

    def seam(rows: pa.Table) -> list[pa.RecordBatch]:
        return [_found_rows(**{c: b.column(c) for c in names}) for b in rows.to_batches()]

    def matrix(rows: pa.Table, column: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows[column].to_pylist()), "u4").reshape(rows.num_rows, width)

    def settled(rows: pa.Table, left: np.ndarray, right: np.ndarray, other: np.ndarray, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of rows that have met all their neighbours: their spans, and the windows that others may hold.

        left, right: the words that some neighbour shares, if at least width in all; run: those ahead that the NEAR-th has too."""
        rows = rows.combine_chunks()
        doc, body = (rows[c].combine_chunks() if rows.num_rows else pa.array([], pa.int64()) for c in ("doc_id", "body"))
        pos = rows["pos"].to_numpy().astype("i8")
        pick = np.flatnonzero(left + right >= width)
        at = pa.array(pick)
        yield _found_rows(doc_id=doc.take(at), body=body.take(at), start=(pos[pick] - left[pick]).astype("i4"), end=(pos[pick] + right[pick]).astype("i4"), other=pa.array(other[pick], mask=other[pick] == NULL))
        most, least = (rows[c].to_numpy().astype("i8") for c in ("most", "least"))
        least = np.maximum(least, width - run)
        for pick in np.array_split(np.flatnonzero(most >= least), max(1, len(most) // 4096)):
            if not len(pick):
                continue
            some = rows.take(pa.array(pick))
            n = (most - least)[pick] + 1
            row = np.repeat(np.arange(len(pick)), n)
            back = least[pick][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key, check = _window_hashes(matrix(some, "ahead"), matrix(some, "behind"), row, back)
            known = (back <= left[pick][row]) & (width - back <= right[pick][row])
            # Of a window that the neighbours account for, one is enough for others to be found by.
            once = np.zeros(len(key), bool)
            once[np.unique(key, return_index=True)[1]] = True
            go = ~known | once
            row, back, key, check = row[go], back[go], key[go], check[go]
            of = pa.array(pick[row])
            yield _found_rows(doc_id=doc.take(of), body=body.take(of), start=(pos[pick][row] - back).astype("i4"), key=key.view("i8"), check=(check >> np.uint64(32)).astype("u4").view("i4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b]).select(names)
            if held is None:
                yield from seam(now.slice(0, NEAR))
                held, left, right, other, shared = now.slice(0, 0), *(np.zeros(0, "i8"),) * 4
            old, rows = held.num_rows, pa.concat_tables([held, now]).combine_chunks()
            n = rows.num_rows
            ahead, behind, doc = matrix(rows, "ahead"), matrix(rows, "behind"), rows["doc_id"].fill_null(NULL).to_numpy()
            left, right, shared = (np.concatenate([x, np.zeros(n - old, "i8")]) for x in (left, right, shared))
            other = np.concatenate([other, doc[old:]])  # another document comes before one's own
            for d in range(1, NEAR + 1):
                at = np.arange(max(0, old - d), n - d)
                if not len(at):
                    continue
                r, l = _reach(ahead[at], ahead[at + d]), _reach(behind[at], behind[at + d])
                if d == NEAR:
                    shared[at], shared[at + d] = np.maximum(shared[at], r), np.maximum(shared[at + d], r)
                long = l + r >= width
                at, r, l = at[long], r[long], l[long]
                for x, y in ((at, at + d), (at + d, at)):
                    left[x], right[x] = np.maximum(left[x], l), np.maximum(right[x], r)
                    other[x] = np.where(other[x] == doc[x], doc[y], other[x])
            done = max(0, n - NEAR)
            yield from settled(rows.slice(0, done), left[:done], right[:done], other[:done], shared[:done])
            held, left, right, other, shared = rows.slice(done), left[done:], right[done:], other[done:], shared[done:]
        if held is not None:
            yield from settled(held, left, right, other, shared)
            yield from seam(held)

    return run


_TWICE = "doc_id long, body long, start int, other long, key long, check int"


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range, the windows that a neighbour has too; its first and last rows come again, with their key."""
    names = ["doc_id", "body", "start", "key", "check"]
    held = None

    def out(rows: pa.Table, other: pa.Array, key: pa.Array, check: pa.Array) -> list[pa.RecordBatch]:
        return pa.table([rows["doc_id"], rows["body"], rows["start"], other, key, check], names=["doc_id", "body", "start", "other", "key", "check"]).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b]).select(names)
        if held is None:
            yield from out(first := now.slice(0, 1), pa.nulls(1, pa.int64()), first["key"], first["check"])
        rows = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
        key, check = rows["key"].to_numpy(), rows["check"].to_numpy()
        same = [rows["doc_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False), *(rows[c].combine_chunks().fill_null(0).to_numpy() for c in ("doc_id", "body", "start"))]
        again = np.logical_and.reduce([x[1:] == x[:-1] for x in same])  # one window, made in both passes
        at = np.flatnonzero((key[1:] == key[:-1]) & (check[1:] == check[:-1]) & ~again)
        pick, other = np.concatenate([at, at + 1]), np.concatenate([at + 1, at])
        k = len(pick)
        if k:
            yield from out(rows.take(pa.array(pick)), rows["doc_id"].combine_chunks().take(pa.array(other)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()))
        held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield from out(held, pa.nulls(1, pa.int64()), held["key"], held["check"])


def _same_windows(windows: DataFrame, min_words: int) -> DataFrame:
    """doc_id, body, start, end, other of the windows (doc_id, body, start, key, check) that stand twice."""
    order = ["key", "check", "doc_id", "body", "start"]
    swept = cut(windows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_twice, _TWICE))
    # Two rows a range, whatever the data.
    seams = swept.where("key IS NOT NULL").select("doc_id", "body", "start", "key", "check").distinct().coalesce(1).sortWithinPartitions(*order)
    both = swept.where("key IS NULL").union(seams.mapInArrow(_twice, _TWICE).where("key IS NULL"))
    return both.select("doc_id", "body", "start", (F.col("start") + min_words).alias("end"), "other")


def repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, other_doc_id: passages of at least min_words that stand elsewhere too.

    Words are runs without ASCII white space, A-Z lower-cased, counted from 0. other_doc_id holds it as well;
    it is doc_id itself if the document repeats its own words."""
    own = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("body"), F.col(text).cast("string").alias("text"))
    kept = cut(suffixes(own, min_words))
    order = ["gram", "doc_id", "body", "pos"]
    places = cut(kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_repeated, "doc_id long, body long, pos long"))
    around = cut(contexts(own, places, min_words))
    order = ["ahead", "behind", "doc_id", "body", "pos"]
    compared = cut(around.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_extend(min_words), _FOUND))
    # A few rows per range, whatever the data.
    seams = compared.where("pos IS NOT NULL").select("ahead", "behind", "doc_id", "body", "pos", "most", "least").distinct().coalesce(1).sortWithinPartitions(*order)
    found = compared.where("pos IS NULL").union(cut(seams.mapInArrow(_extend(min_words), _FOUND)).where("pos IS NULL"))
    windows = found.where("key IS NOT NULL").select("doc_id", "body", "start", "key", "check")
    spans = ["doc_id", "body", "start", "end", "other"]
    found = found.where("key IS NULL").select(spans).union(_same_windows(windows, min_words))
    by = Window.partitionBy("doc_id", "body").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("doc_id", "body", "start", "end", "other").withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    spans = spans.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "body", "span").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.coalesce(F.min(F.when(F.col("other") != F.col("doc_id"), F.col("other"))), F.min("other")).alias("other_doc_id"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id")
