"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A store is a folder: `changes/batch=ID` holds each batch's ledger rows, `deltas/batch=ID` the signed
sums by key that follow from them, `commits/ID` marks a batch as done. A batch is written whole before
it is marked; one that failed half-way is overwritten by its next attempt, and one that is marked is
skipped, so that committing a batch twice changes nothing. Totals are sums over committed deltas. Every
COMPACT_AFTER batches, what is committed is put together below `whole/`, where later reads begin.

A change is (op, doc_id, source, lang, version, tokens): insert adds a document; revise replaces the
count or the key that a document has under the version; delete takes the document's row away. Revise
and delete are turned into the negative of what the ledger holds. Within a batch, the last change of a
document and version counts (seq, then the remaining columns decide ties). Inserting a document that is
there revises it; deleting one that is not does nothing.

Nulls: null keys are keys; null counts are zero. A document without an id is known by its text, source
and language (body, a hash of them, beside the null id). Repeated changes are one change; of rows of one
id with several texts, the last one counts, as for any document that changes. Very long texts are counted
whole. Columns beyond those named are ignored; an empty batch is a batch without deltas.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import few

KEY = ["source", "lang", "version"]
#: insert and revise give a document's count, whether it was there or not; delete takes it away. Rows of other ops, or none, change nothing.
OPS = ("insert", "revise", "delete")
#: Batches that a read adds up before they are put into one.
COMPACT_AFTER = 16
_LEDGER = "doc_id long, body long, version string, source string, lang string, tokens long, live boolean, batch long"
_DELTA = "source string, lang string, version string, docs long, tokens long, batch long"


def count_tokens(docs: DataFrame, version: str = "byte_bpe_50k", ranks_path: str | None = None) -> DataFrame:
    """docs' doc_id, source, lang, body with version and tokens, the count of the whole text's ids."""
    where = ranks_path or tokens.default_path(f"{version}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.id_bytes(where)
        for b in few(batches):
            yield b.drop_columns(["text"]).append_column("tokens", pa.array([len(encode(t or "")) // 4 for t in b.column("text").to_pylist()], pa.int64()))

    return keyed(docs).mapInArrow(run, "doc_id long, source string, lang string, body long, tokens long").withColumn("version", F.lit(version))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, body, by which documents without an id are told apart (0 for others), and text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return own.select("doc_id", "source", "lang", F.when(F.col("doc_id").isNull(), F.xxhash64("text", "source", "lang")).otherwise(F.lit(0).cast("long")).alias("body"), "text")


def estimate_tokens(docs: DataFrame, version: str = "byte_bpe_50k") -> DataFrame:
    """As count_tokens, by length alone: a token for four characters. For counts that a later batch revises."""
    return keyed(docs).select("doc_id", "source", "lang", "body", F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).cast("long").alias("tokens"), F.lit(version).alias("version"))


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        p = self._path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _begin(self) -> int | None:
        """The last batch that a compaction holds."""
        return max(self.batches("compactions"), default=None)

    def batches(self, marks: str = "commits") -> list[int]:
        if not self._exists(marks):
            return []
        p = self._path(marks)
        return sorted(int(x.getPath().getName()) for x in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p))

    def _read(self, name: str, schema: str) -> DataFrame:
        done = self.batches()
        plain = ", ".join(schema.split(", ")[:-1])
        if not done:
            return self.spark.createDataFrame([], schema)
        begin = self._begin()

        def read(where: str, batches: list[int]) -> DataFrame:
            paths = [f"{where}/batch={i}" for i in batches]
            return self.spark.read.schema(plain).option("basePath", where).parquet(*paths).withColumn("batch", F.col("batch").cast("long"))

        later = [i for i in done if begin is None or i > begin]
        parts = [read(f"{self.path}/whole/{name}", [begin])] if begin is not None else []
        parts += [read(f"{self.path}/{name}", later)] if later else []
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def ledger(self, asked: DataFrame | None = None) -> DataFrame:
        """The live row of each document and version; of those in asked (doc_id, body, version) alone, if given.

        What was asked for is picked before rows meet, so that a batch costs a scan and its own documents' rows."""
        rows = self._read("changes", _LEDGER)
        if asked is not None:
            wanted = asked.select(F.col("doc_id").alias("d"), F.col("body").alias("b"), F.col("version").alias("v"))
            rows = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["body"] == F.col("b")) & rows["version"].eqNullSafe(F.col("v")), "left_semi")
        newest = rows.groupBy("doc_id", "body", "version").agg(F.max_by(F.struct("source", "lang", "tokens", "live"), "batch").alias("x"))
        return newest.select("doc_id", "body", "version", "x.*").where("live").drop("live")

    def compact(self) -> None:
        """Put what is committed into one ledger and one set of totals, which later reads begin from. Run again, it changes nothing."""
        done = self.batches()
        if not done or self._begin() == done[-1]:
            return
        at = done[-1]
        self.ledger().withColumn("live", F.lit(True)).write.mode("overwrite").parquet(f"{self.path}/whole/changes/batch={at}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/whole/deltas/batch={at}")
        mark = self._path(f"compactions/{at}")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, True).close()

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; keys without documents are left out."""
        return self._read("deltas", _DELTA).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (op, doc_id, source, lang, version, tokens, optionally seq and body) as batch; False if it was there already."""
        if self._exists(f"commits/{int(batch)}"):
            return False
        done = self.batches()
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} is older than {done[-1]}, which is committed")
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        body = F.col("body").cast("long") if "body" in changes.columns else F.lit(0).cast("long")
        rows = changes.where(F.col("op").isin(*OPS)).select("op", F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), "source", "lang", "version", F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"), seq.alias("seq"))
        last = rows.groupBy("doc_id", "body", "version").agg(F.max(F.struct("seq", "op", "source", "lang", "tokens")).alias("x")).select("doc_id", "body", "version", "x.*").drop("seq")
        last.select("doc_id", "body", "version", "source", "lang", "tokens", (F.col("op") != "delete").alias("live")).write.mode("overwrite").parquet(f"{self.path}/changes/batch={int(batch)}")
        new = self.spark.read.parquet(f"{self.path}/changes/batch={int(batch)}")
        signed = [new.where("live").select(*KEY, F.lit(1).alias("docs"), "tokens")]
        if done:
            signed.append(self.ledger(new).select(*KEY, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens")))
        delta = signed[0] if len(signed) == 1 else signed[0].union(signed[1])
        delta.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={int(batch)}")
        mark = self._path(f"commits/{int(batch)}")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, True).close()
        begin = self._begin()
        if sum(begin is None or i > begin for i in self.batches()) > COMPACT_AFTER:
            self.compact()
        return True
