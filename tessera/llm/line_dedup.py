"""Line dedup by a range-partitioned sort of line hashes.

Each long enough line gives a row (hash, doc_id, position). The rows are dealt by ranges of (hash,
doc_id) and sorted within each range, largest doc_id first; one pass over a sorted range then sees a
line's documents one after the other and streams out what the first of them makes superfluous. A line
that fills several ranges is settled by a summary of two rows per range. What comes back is a
compressed keep bitmap per document, not text.

Nulls: a null text is one empty line; a null doc_id sorts below all others and counts as one document.
Repeated rows of one doc_id are one document. Very long texts are split whole. Columns beyond doc_id and
text are ignored by dropped_lines() and kept by the others, whatever their names are; an empty table gives
an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, ascii_lower, cut

#: A null doc_id in the sorted rows.
NONE = -(2**63)
_OUT = "kind int, h1 long, h2 long, doc long, body long, pos int, n long, top long"


def _rows(docs: DataFrame, min_chars: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc"), F.xxhash64(text).alias("body"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "body", "pos", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(9), "key").alias("h2"), "doc", "body", "pos")


def _sweep(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Over one sorted range: kind 0 rows to drop, kind 1 rows that hang on other ranges, kind 2 summaries.

    Only a range's first line can have begun in an earlier range, and only its last can go on in a
    later one. Between batches, of the line at hand only its first two documents' rows are held."""
    names = ("h1", "h2", "doc", "body", "pos")
    held, first = None, None

    def out(kind: int, rows: dict, pick: np.ndarray) -> pa.RecordBatch:
        n = int(pick.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, "i4"))] + [pa.array(rows[c][pick]) for c in names] + [pa.nulls(n, pa.int64())] * 2,
            names=["kind", *names, "n", "top"],
        )

    def summary(h: tuple, n: int, top: int) -> pa.RecordBatch:
        one = lambda v, t="i8": pa.array(np.array([v], t))
        return pa.RecordBatch.from_arrays([one(2, "i4"), one(h[0]), one(h[1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), one(n), one(top)], names=["kind", *names, "n", "top"])

    # the line at hand: its hash, documents so far, its largest and its latest document
    line, n_docs, top, latest = None, 0, 0, None
    first_docs, first_top = 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        rows = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
        if first is None:
            first = (int(rows["h1"][0]), int(rows["h2"][0]))
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
        new_line = np.ones(len(rows["doc"]), bool)
        new_line[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
        new_doc = new_line.copy()
        new_doc[1:] |= rows["doc"][1:] != rows["doc"][:-1]
        start, of, docs_to = np.flatnonzero(new_line), np.cumsum(new_line) - 1, np.cumsum(new_doc)
        before, tops = np.zeros(len(start), "i8"), rows["doc"][start]
        if held is None and line == (int(rows["h1"][0]), int(rows["h2"][0])):  # its earlier rows are gone, but count
            before[0] = n_docs - (latest == int(rows["doc"][0]))
            tops[0] = top
        nth = docs_to - docs_to[start][of] + 1 + before[of]
        total = np.maximum.reduceat(nth, start)
        is_first = (rows["h1"] == first[0]) & (rows["h2"] == first[1])
        yield out(0, rows, ~is_first & (rows["doc"] != tops[of]) & (total[of] >= min_docs))
        yield out(1, rows, is_first)
        if is_first[0]:
            first_docs, first_top = int(total[0]), int(tops[0])
        line, n_docs, top, latest = (int(rows["h1"][-1]), int(rows["h2"][-1])), int(total[-1]), int(tops[-1]), int(rows["doc"][-1])
        settled = line == first or n_docs >= min_docs
        held = None if settled else {c: rows[c][start[-1] :] for c in names}
    if first is not None:
        yield summary(first, first_docs, first_top)
        if line != first:
            yield summary(line, n_docs, top)
        if held is not None:
            yield out(1, held, np.ones(len(held["doc"]), bool))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, body, pos) of every line that goes. docs: doc_id, text."""
    keys = cut(_rows(docs, min_chars))  # else texts would be split twice, once to find the ranges
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order, F.col("body"), F.col("pos"))
    swept = cut(ranged.mapInArrow(lambda it: _sweep(it, min_docs), _OUT))
    # Two rows per range at most: bounded by the number of partitions, whatever the data.
    total = swept.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("top").alias("largest"))
    open_rows = swept.where("kind = 1").select("h1", "h2", "doc", "body", "pos")
    settled = open_rows.join(F.broadcast(total), ["h1", "h2"]).where((F.col("docs") >= min_docs) & (F.col("doc") != F.col("largest")))
    return swept.where("kind = 0").select("doc", "body", "pos").union(settled.select("doc", "body", "pos"))


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n, gone):
        if gone is None:
            return None
        keep = np.ones(int(n), bool)
        keep[gone] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(n, g) for n, g in zip(n_lines, dropped, strict=True)])


@F.pandas_udf(T.StringType())
def _apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t, packed):
        if t is None or packed is None:
            return None
        lines = t.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), "u1"), count=len(lines))
        return "\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)])


def dropped_by_document(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, body, dropped) for the documents that lose lines: sorted positions, each once.

    doc and body (a hash of the text) together name a row of docs, also where ids repeat."""
    return dropped_lines(docs, min_chars, min_docs).groupBy("doc", "body").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs' columns in a struct doc, with n_lines, n_dropped, keep_bitmap (null: all lines stay) and kept_text."""
    found = dropped_by_document(docs.select("doc_id", "text"), min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("doc_row"), F.coalesce("text", F.lit("")).alias("t"))
    on = (F.coalesce(F.col("doc_row.doc_id"), F.lit(NONE)) == F.col("doc")) & (F.xxhash64("t") == F.col("body"))
    n_lines = F.length("t") - F.length(F.translate("t", "\n", "")) + 1
    joined = rows.join(found, on, "left").select("doc_row", "t", "dropped", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    losing = F.col("dropped").isNotNull()
    packed = joined.withColumn("keep_bitmap", _bitmap("n_lines", "dropped"))
    kept = _apply(F.when(losing, F.col("t")), "keep_bitmap")
    return packed.withColumn("cut", kept).select(F.col("doc_row").alias("doc"), "n_lines", "n_dropped", "keep_bitmap", F.when(losing, F.col("cut")).otherwise(F.col("t")).alias("kept_text"))


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with text cut to the kept lines and n_chars, if there is one, counted anew; null texts stay null."""
    found = line_dedup(docs, min_chars, min_docs)
    text = F.when(F.col("doc.text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return found.select([new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH l AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, r, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM l),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[ 	-
]+', ''), '[ 	-
]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id, r
"""
