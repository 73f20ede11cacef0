"""What several operators of this subpackage share: shared-folder tables, hashing, word rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, release  # noqa: F401

#: ASCII white space; the complement makes words.
SPACE = " \t\n\u000b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The files lie below the application's id."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_anew(df: DataFrame, old: DataFrame | None) -> DataFrame:
    """cut(df); old, a table that cut() wrote and that nothing else reads, is then removed."""
    new = cut(df)
    if old is not None:
        for path in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
    return new


def hash_sample(df: DataFrame, n: int, most: int, *keys: str) -> DataFrame:
    """About `most` of df's n rows (all, if there are no more): those whose keys' hash falls into that share.

    Every task picks its own; nothing is sorted or sent but the sample. Adds the hash as h."""
    share = min(1.0, 0.95 * most / max(n, 1)) if n > most else 1.0
    return df.withColumn("h", F.xxhash64(*keys)).where(F.shiftrightunsigned("h", 11) < int(share * 2**53))


def few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that a task holds the Python objects of a few documents at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Maximal runs of other characters than ASCII white space."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
