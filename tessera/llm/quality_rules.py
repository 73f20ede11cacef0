"""Quality rules by cross-document line frequency, on DataFrame functions alone.

Normalised lines are hashed; for each host the distinct documents that hold a line are counted;
lines above the limits count as removed, and a document that loses too many of its words is rejected.
Exact copies count as one document: a text that was copied a thousand times brings its lines into a
thousand documents, and copies are for the near-duplicate operators to deal with. The lines of a block
are counted each for itself, whatever stands beside them, so that a block goes whole.

Nulls: a null text is an empty one (no words, base_failed); a null host is a host of its own; a null
id stays null. Repeated rows are judged one by one and count as one document if their ids agree; the
limit of a host is a share of its rows. Very long texts are judged whole. Columns beyond the id, the text
and the host are ignored by quality_rules() and kept by keep_good(), whatever their names are; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, cut, let, words_of

WINDOW = 8
#: A hot line's rows are spread over so many keys when they meet its count.
SALTS = 16


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that the text holds twice or more."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def twice(s: Column) -> Column:
        found = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        own = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    def count(hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(keyed, lambda s: let(twice(s), covered)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), count)))


def _lines(lines: Column) -> Column:
    """Per line with words: two hashes of the normalised line, its words."""

    def rows(norm: Column) -> Column:
        made = F.transform(
            norm,
            lambda x: F.struct(
                F.xxhash64(x).alias("h1"),
                F.xxhash64(F.lit(9), x).alias("h2"),
                F.when(x == "", 0).otherwise(F.size(F.split(x, SPACE_CLASS + "+"))).alias("n"),
            ),
        )
        return F.filter(made, lambda r: r["n"] > 0)

    return let(F.transform(lines, lambda x: F.lower(F.btrim(x, F.lit(SPACE)))), rows)


def measures(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of docs: the base counts, and the lines' hashes."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc).alias("doc_id"), F.col(host).cast("string").alias("host"), body.alias("body"), words_of(body).alias("words"), F.split(body, "\n").alias("lines"))
    worded = let(F.filter(F.col("lines"), lambda x: F.btrim(x, F.lit(SPACE)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return base.select(
        "doc_id",
        "host",
        F.monotonically_increasing_id().alias("row_id"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        worded.cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.xxhash64("body").alias("copy"),
        _lines(F.col("lines")).alias("lines"),
    )


def line_frequency(lines: DataFrame) -> DataFrame:
    """(host, h1, h2) -> n_docs, the distinct documents, exact copies counted once.

    lines: host, h1, h2, copy, a hash of the whole text, doc_id. The last step adds up partial sums before
    its shuffle, so that a line of a third of all documents arrives as one row per task."""
    once = lines.groupBy("host", "h1", "h2", "doc_id").agg(F.min("copy").alias("copy"))
    texts = once.groupBy("host", "h1", "h2", "copy").agg(F.lit(1).alias("n"))
    return texts.groupBy("host", "h1", "h2").agg(F.sum("n").alias("n_docs"))


def quality_rules(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = 20, share: float = 0.002, max_removed: float = 0.7) -> DataFrame:
    """Verdict per row: base counts, n_removed_words, n_removed_lines, kept.

    A line goes if over max(min_docs, share of its host's documents) documents of the host hold it,
    of which exact copies count once. A document is depleted if over max_removed of its words go."""
    rows = cut(measures(docs, doc, text, host))
    lines = rows.select("row_id", "doc_id", "host", "copy", F.explode("lines").alias("x")).select("row_id", "doc_id", "host", "copy", "x.*")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    often = line_frequency(lines).where(F.col("n_docs") > min_docs)
    # Hosts may be as many as documents: a plain join, whose hot host has one row on either side's key and line.
    often = often.join(hosts, often["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    limit = F.greatest(F.lit(float(min_docs)), F.col("host_docs") * share)
    often = often.where(F.col("n_docs") > limit).select(
        F.coalesce("host", F.lit("\0")).alias("f_host"), F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt")
    )
    salted = lines.withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int"))
    on = (F.coalesce("host", F.lit("\0")) == F.col("f_host")) & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")) & (F.col("salt") == F.col("f_salt"))
    removed = salted.join(often, on).groupBy(F.col("row_id").alias("r_id")).agg(F.sum("n").alias("r_words"), F.count(F.lit(1)).alias("r_lines"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    gone = F.coalesce("r_words", F.lit(0)).cast("long")
    return rows.join(removed, F.col("row_id") == F.col("r_id"), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        gone.alias("n_removed_words"), F.coalesce("r_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        (~failed & (gone <= F.col("n_words") * max_removed)).alias("kept"),
    )


def keep_good(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs, as they are, whose verdict is kept. Rows are matched by id, text and host, so that ids may repeat."""
    # The user's columns go by number here, so that none can clash.
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc_id, body, of = (F.col(names[docs.columns.index(c)]) for c in (doc, text, host))
    key = F.struct(doc_id.alias("id"), F.xxhash64(body).alias("body"), of.cast("string").alias("host"))
    good = quality_rules(rows.select(key.alias("doc_id"), body.alias("text"), of.alias("source"))).where("kept").select(*(F.col(f"doc_id.{c}").alias(f"good_{c}") for c in ("id", "body", "host")))
    on = doc_id.eqNullSafe(F.col("good_id")) & (F.xxhash64(body) == F.col("good_body")) & of.cast("string").eqNullSafe(F.col("good_host"))
    return rows.join(good, on, "left_semi").toDF(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, source AS host, row_number() OVER () AS row_id, coalesce(text, '') AS body FROM documents),
t AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, string_split(body, chr(10)) AS lines FROM d),
w AS (SELECT row_id, i, list_slice(words, i, i + 7) AS win FROM t, unnest(range(1, greatest(len(words) - 6, 1))) AS u(i)),
m AS (SELECT row_id, unnest(range(i, i + 8)) AS p FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, win) AS c FROM w) WHERE c > 1),
r AS (SELECT row_id, count(DISTINCT p) AS n FROM m GROUP BY row_id),
l AS (SELECT row_id, doc_id, host, body, unnest(list_transform(lines, lambda x: lower(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')))) AS x FROM t),
a AS (SELECT row_id, doc_id, host, body, x, len(regexp_split_to_array(x, '[\x20\x09-\x0D]+')) AS n FROM l WHERE x <> ''),
o AS (SELECT host, x, doc_id, min(body) AS body FROM a GROUP BY ALL),
f AS (SELECT host, x, count(DISTINCT body) AS n_docs FROM o GROUP BY ALL),
h AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
z AS (SELECT f.host, f.x FROM f JOIN h ON f.host IS NOT DISTINCT FROM h.host WHERE n_docs > greatest(20, host_docs * 0.002)),
g AS (SELECT row_id, sum(n) AS words, count(*) AS lines FROM a JOIN z ON a.host IS NOT DISTINCT FROM z.host AND a.x = z.x GROUP BY row_id),
b AS (SELECT t.doc_id, t.row_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN r USING (row_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CAST(coalesce(g.words, 0) AS BIGINT) AS n_removed_words,
  CAST(coalesce(g.lines, 0) AS BIGINT) AS n_removed_lines, NOT base_failed AND coalesce(g.words, 0) <= n_words * 0.7 AS kept
FROM v LEFT JOIN g USING (row_id)
"""
