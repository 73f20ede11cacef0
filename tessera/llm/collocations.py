"""Phrase collocations, counted by prefix-free parsing.

A piece of text is cut where a hash of the next few words says so. A chunk runs from one such window of words
to the end of the next, so that neighbours share the window and equal passages give equal chunks wherever
they stand. The distinct chunks are the dictionary, with the parse's frequencies; n-grams are counted
within distinct chunks alone, each as often as its chunk occurs. Those that begin in a window shared with
the next chunk are the next chunk's, so that every occurrence counts once.

Whatever can matter later occurs `least` times, parts and longer candidates too, so that the table of
n-grams is filtered once and all joins run on what is left. Common words are common keys there; those joins are
plain ones, which AQE splits.

Nulls: a null text is empty, a null language is `und`. Repeated rows count each; very long texts are read whole;
equal scores go by count, then by the phrase's bytes. Columns beyond the text and the language are ignored,
whatever their names are; an empty table, or one without candidates, gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, few
from .tokens import Memo

ENDS = re.compile("[.,;:!?\n\u000b\f\r]+")
#: Mean distance of triggering windows, in words.
SPREAD = 16
#: A task's own counts are passed on when it holds so many different strings.
TASK_KEYS = 400_000
#: Counts meet in parts by their string's hash, one for so many characters of text, so that a part fits in a task.
PART_CHARS = 8_000_000
#: First ranking per language in so many parts.
PARTS = 64


def split_pieces(text: str | None) -> Iterator[str]:
    """Each piece that has words, with single spaces between them."""
    text = (text or "").replace("\t", " ")
    text = text.lower() if text.isascii() else text.encode().lower().decode()  # on bytes lower() knows ASCII alone
    for piece in ENDS.split(text):
        if piece := piece.strip(" "):
            yield " ".join(filter(None, piece.split(" "))) if "  " in piece else piece


def chunks(words: list[str], width: int, code: Memo, spread: int = SPREAD) -> Iterator[tuple[list[str], bool]]:
    """(words, whether the last `width` of them are the next chunk's too)."""
    begin = 0
    if len(words) > width:
        codes, last = list(map(code.__getitem__, words)), len(words) - width
        sums = codes if width == 1 else map(sum, zip(*(codes[i:] for i in range(width)), strict=False))
        for at, x in enumerate(sums):
            if x % spread == 0 and 0 < at < last:
                yield words[begin : at + width], True
                begin = at
    yield words[begin:], False


class Tally:
    """Counts by language and string, passed on in blocks by part: a string's part is that of its hash."""

    schema = "part int, lang string, size int, block binary"

    def __init__(self, parts: int):
        self.parts, self.by_lang = parts, {}

    def of(self, lang: str) -> Counter:
        held = self.by_lang.get(lang)
        if held is None:
            held = self.by_lang[lang] = Counter()
        return held

    def full(self) -> bool:
        return sum(map(len, self.by_lang.values())) >= TASK_KEYS

    def blocks(self) -> pa.RecordBatch:
        codec, parts, crc, rows = pa.Codec("zstd"), self.parts, zlib.crc32, []
        for lang, counts in self.by_lang.items():
            by_part: list[list[str]] = [[] for _ in range(parts)]
            for key, n in counts.items():
                by_part[crc(key.encode()) % parts].append(key if n == 1 else f"{key}\t{n}")
            for part, lines in enumerate(by_part):
                if lines:
                    raw = "\n".join(lines).encode()
                    rows.append((part, lang, len(raw), codec.compress(raw, asbytes=True)))
        self.by_lang.clear()
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["part", "lang", "size", "block"])


def met(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks of one part next to each other, a part in one task."""
    return blocks.repartition(parts, "part").sortWithinPartitions("part")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, dict[str, int]]]:
    """Per part, by language, its strings' counts."""
    codec, held, current = pa.Codec("zstd"), {}, None
    for b in few(batches, 64):
        for part, lang, size, block in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if part != current and held:
                yield held
                held = {}
            current, counts = part, held.setdefault(lang, {})
            get = counts.get
            for line in codec.decompress(block, size, asbytes=True).decode().split("\n"):
                key, tab, n = line.partition("\t")
                counts[key] = get(key, 0) + (int(n) if tab else 1)
    if held:
        yield held


def parse(rows: DataFrame, longest: int, parts: int, spread: int = SPREAD) -> DataFrame:
    """Blocks of the dictionary of rows (lang, text), yet to be merged. A chunk that goes on ends with a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, code = Tally(parts), Memo(lambda w: zlib.crc32(w.encode()) >> 3)
        for b in few(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held, whole = tally.of(lang), []
                for piece in split_pieces(text):
                    if piece.count(" ") < spread:  # as long as a chunk, so it is one
                        whole.append(piece)
                        continue
                    for chunk, goes_on in chunks(piece.split(" "), longest - 1, code, spread):
                        held[" ".join(chunk) + " " if goes_on else " ".join(chunk)] += 1
                held.update(whole)
                if tally.full():
                    yield tally.blocks()
        yield tally.blocks()

    return rows.mapInArrow(run, Tally.schema)


def count_grams(dictionary: DataFrame, longest: int, parts: int, least: int) -> DataFrame:
    """(lang, phrase, f): all n-grams up to `longest` words that occur `least` times, and as the empty phrase the
    number of words."""
    width = longest - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(parts)
        for by_lang in merged(batches):
            for lang, found in by_lang.items():
                for chunk, n in found.items():
                    held = tally.of(lang)
                    words = chunk.split(" ")
                    own = len(words)
                    if not words[-1]:
                        words.pop()
                        own -= 1 + width
                    grams = list(words)
                    for size in range(1, longest + 1):
                        grams = grams if size == 1 else [f"{x} {y}" for x, y in zip(grams, words[size - 1 :], strict=False)]
                        if n == 1:
                            held.update(grams if own >= len(grams) else grams[:own])
                        else:
                            for g in grams[:own]:
                                held[g] += n
                    held[""] += own * n
                    if tally.full():
                        yield tally.blocks()
        yield tally.blocks()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for by_lang in merged(batches):
            for lang, found in by_lang.items():
                kept = [(g, n) for g, n in found.items() if n >= least or not g]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(kept)), pa.array([g for g, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["lang", "phrase", "f"])

    grams = met(dictionary, parts).mapInArrow(count, Tally.schema)
    return met(grams, parts).mapInArrow(add, "lang string, phrase string, f long")


def parts_of(phrase, begin: int, size: int):
    return F.array_join(F.slice(F.split(phrase, " "), begin + 1, size), " ")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000, spread: int = SPREAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to `longest` words that occur `least` times; not those within a longer one that occurs
    `covered` percent as often."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(size // PART_CHARS) + 1
    grams = count_grams(parse(rows, longest, parts, spread), longest, parts, least)
    grams = cut(grams.withColumn("size", F.size(F.split("phrase", " "))))
    words = grams.where("phrase = ''").select("lang", F.col("f").alias("n"))  # a row for each language
    counts = grams.where("phrase <> ''")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))

    # Phrases that a longer candidate holds, with the most frequent of those.
    inner = F.array(*(F.struct(F.lit(size).alias("of"), parts_of(F.col("phrase"), at, part).alias("part")) for size in range(3, longest + 1) for part in range(2, size) for at in range(size - part + 1)))
    if longest > 2:
        held = found.select("lang", "a", F.explode(F.filter(inner, lambda x: x["of"] == F.col("size"))).alias("x")).groupBy("lang", F.col("x.part").alias("phrase")).agg(F.max("a").alias("longer"))
        found = found.join(held, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(covered)} * a").drop("longer")

    ways = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), parts_of(F.col("phrase"), F.lit(0), k).alias("left"), parts_of(F.col("phrase"), k, F.col("size") - k).alias("right")))
    ways = found.select("lang", "phrase", "a", F.explode(ways).alias("way")).select("lang", "phrase", "a", "way.*")
    of = lambda name, side: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    ways = ways.join(of("l", "left"), ["lang", "left"]).join(of("r", "right"), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products pass 64 bits
    ways = ways.withColumn("up", F.lit(1_000_000).cast("decimal(38,0)") * whole("a") * whole("a")).withColumn("down", whole("l") * whole("r"))
    scored = ways.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    scored = scored.select("lang", "phrase", "a", "x.l", "x.r", "x.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "part"], ["lang"]):  # no task ranks more than PARTS * top rows of a language
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return scored.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces
), placed AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM worded
), grams AS (
    SELECT lang, size, array_to_string(words[pos:pos + size - 1], ' ') AS phrase, count(*) AS f
    FROM placed, (VALUES (1), (2), (3)) AS s(size) WHERE pos + size - 1 <= len(words) GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang
), found AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM grams WHERE size > 1 AND f >= 10
), longer AS (
    SELECT lang, phrase, max(a) AS f FROM (
        SELECT lang, a, array_to_string(words[1:2], ' ') AS phrase FROM found WHERE size = 3
        UNION ALL SELECT lang, a, array_to_string(words[2:3], ' ') FROM found WHERE size = 3
    ) GROUP BY ALL
), ways AS (
    SELECT c.lang, c.phrase, c.a, k, array_to_string(words[1:k], ' ') AS before, array_to_string(words[k + 1:size], ' ') AS after
    FROM (SELECT *, unnest(range(1, size)) AS k FROM found) c LEFT JOIN longer USING (lang, phrase)
    WHERE longer.f IS NULL OR 100 * longer.f < 50 * c.a
), scored AS (
    SELECT w.lang, w.phrase, w.a, x.f AS l, y.f AS r, w.k, CAST(CAST(1000000 AS HUGEINT) * w.a * w.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM ways w JOIN grams x ON x.lang = w.lang AND x.phrase = w.before JOIN grams y ON y.lang = w.lang AND y.phrase = w.after
), least AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
