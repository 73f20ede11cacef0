"""Small document tables with every awkward case, and plain word rules."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside.
CLASHING = ["__id", "__body", "__all", "__nth", "__host", "ids", "cell", "v", "h", "every", "text_body", "batch", "op", "node", "body", "row_id", "pos", "h1", "key", "n", "doc", "tokens", "span", "length", "words"]


def passage(rnd: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple]:
    rnd = random.Random(11)
    base = passage(rnd, 120)
    words = base.split()
    shared = passage(rnd, 70)
    line = "All rights are reserved by the owner"
    rows = [
        (0, None), (1, ""), (2, "   \n\t "), (3, base), (4, base), (5, base + "\n" + line), (6, line.upper() + " \n" + passage(rnd, 60)),
        (7, "  " + line + "\nshort\nshort\n" + passage(rnd, 30)), (8, passage(rnd, 40) + " " + shared + " " + passage(rnd, 30)), (9, passage(rnd, 25) + " " + shared),
        (10, " ".join(words[:60] + ["changed"] + words[61:])), (11, "one two"), (12, "One TWO"), (13, passage(rnd, 20000, 5000)), (14, (passage(rnd, 9, 30) + " ") * 12),
        (15, "mail a.b@example.com or call +1 (389) 555-5010 at 10.0.0.255, card 4111 1111 1111 1111, token = \"11acdfb36bb72224148e6160f674b4be45601bff\""),
        (16, "é 漢字 😀 \r\n ²½   end  two  spaces"), (17, "x" * 5000), (None, "a row without an id but with some words in it"), (3, base), (19, passage(rnd, 200)),
        (20, "x<|endoftext|> y  <|endoftext|>\n<|endoftext|"), (None, "another row without an id"), (21, passage(rnd, 40_000, 9000)),
    ]
    return [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}" if i != 9 else None, None if t is None else len(t)) for i, t in rows]


def table(spark: SparkSession, rows: list[tuple] | None = None, clashing: bool = False) -> DataFrame:
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in CLASHING}) if clashing else df


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, width: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
