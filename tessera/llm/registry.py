"""One query per operator, opN_<name>, over the whole of its table, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_transducer, collocations, lattice_lm, line_dedup, multi_index, packing, pii, quality_rules, signature_join, suffix_dedup, token_rollup, toxicity, whitening
from .common import cut, new_path, table


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a table's life in batches: inserted with estimates, revised to counted tokens, exact copies deleted
    and put back. Two batches come twice. What is left has to be the plain totals of all documents."""
    docs = table(spark, sf_dir, "documents")
    rollup, counted = token_rollup.Rollup(spark, new_path(spark)), cut(token_rollup.count_tokens(docs))
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).where("doc_id IS NOT NULL")
    first = text.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"))
    copies = text.join(first, "text_hash").where("doc_id <> first_id").select("doc_id").distinct()
    copied = cut(counted.join(copies, "doc_id", "left_semi"))
    rollup.commit(1, token_rollup.estimate_tokens(docs).withColumn("op", F.lit("insert")))
    for _ in range(2):
        rollup.commit(2, counted.withColumn("op", F.lit("revise")))
    for _ in range(2):
        rollup.commit(3, copied.withColumn("op", F.lit("delete")))
    rollup.commit(4, copied.withColumn("op", F.lit("insert")))
    return rollup.totals()


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.where("vec_id % 20 = 0"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.digests(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.link(table(spark, sf_dir, "documents"), width=3, num=90).drop("body")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"))


def op11_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_array, op2_token_rollup, op3_best_fit_packing, op4_pii_boosting, op5_multi_index,
    op6_bpe_transducer, op7_line_dedup, op8_signature_join, op9_quality_rules, op10_lattice_lm,
    op11_toxicity_gru, op12_qd_whitening, op13_phrase_collocations,
)}
ORACLES = {"op7_line_dedup": line_dedup.SQL, "op9_quality_rules": quality_rules.SQL, "op13_phrase_collocations": collocations.SQL}
