"""Tables of documents and chunks: keep-last upserts, look-ups, counts, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest order for each key, by partial aggregation: no key's rows are gathered."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), *[c for c in rest if c != order])).alias("__x"))
    return newest.select(*keys, *[F.col("__x")[c].alias(c) for c in rest]).select(rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old without the keys of new, and new's last row of each key."""
    latest = keep_last(new, keys, order)
    return old.join(latest.select(keys), keys, "left_anti").unionByName(latest)


def write(rows: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    out = rows.write.mode(mode)
    (out.partitionBy(by) if by else out).parquet(path)


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's columns; chunks of unknown documents stay."""
    return chunks.join(documents, "doc_id", "left")


def looked_up(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits whose chunk is known, ranks as they were."""
    return hits.join(chunks, key, "inner")


def document(documents: DataFrame, doc_id) -> DataFrame:
    """The row of one document, or none: a filter that reaches the files."""
    return documents.where(F.col("doc_id") == F.lit(doc_id))


def document_rows(chunks: DataFrame) -> DataFrame:
    """One row per document from its first chunk, with the number of chunks."""
    first = F.min_by("metadata", F.struct("chunk_index", "metadata"))
    return chunks.groupBy("doc_id").agg(first.alias("metadata"), F.count(F.lit(1)).alias("n_chunks"))


def cached(texts: DataFrame, cache: DataFrame, compute) -> DataFrame:
    """texts (text) with value: from cache (key, value) by the text's hash, else compute(text), once per different text."""
    keyed = texts.withColumn("key", F.sha2("text", 256))
    missing = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    known = cache.select("key", "value").unionByName(missing.select("key", compute(F.col("text")).alias("value")))
    return keyed.join(known, "key", "left").drop("key")


class Backups:
    """Versions of a table folder: path/v=N, newest first, the oldest beyond `keep` removed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs()
        return sorted((int(s.getPath().getName()[2:]) for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []

    def create(self, rows: DataFrame) -> int:
        n = max(self.versions(), default=0) + 1
        rows.write.parquet(f"{self.path}/v={n}")
        return n

    def due(self, processed: int, every: int = 1000) -> bool:
        """Whether so many documents since the last version call for another."""
        return processed >= every

    def statistics(self) -> DataFrame:
        """One row: versions, their bytes, the oldest and the newest number."""
        _, fs = self._fs()
        rows = [(v, fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}")).getLength()) for v in self.versions()]
        return self.spark.createDataFrame(rows, "version int, bytes long").agg(F.count(F.lit(1)).alias("versions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("version").alias("oldest"), F.max("version").alias("newest"))

    def restore(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={version or self.versions()[0]}")

    def same(self, version: int, rows: DataFrame) -> bool:
        """Whether a version holds the same rows, by count and sum of hashes."""
        measure = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)"))).first())
        return measure(self.restore(version)) == measure(rows)

    def prune(self, keep: int) -> list[int]:
        _, fs = self._fs()
        gone = self.versions()[keep:]
        for v in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}"), True)
        return gone
