"""Language-model scores by subword lattices, beside a smoothed word unigram.

A word's probability is the sum over all its segmentations into vocabulary pieces, by forward recursion
in log space. Pieces do not span words, so a text's marginal is the product over its words, and each
different word goes through the lattice once. The vocabulary files at hand carry merge ranks instead of
unigram probabilities; the pieces' probabilities are therefore estimated here, by add-one smoothing,
from the training documents.

Words are counted in every document. Words that make up at least 1/`hot` of all tokens, `hot` of them
at most whatever the data, are scored where the documents are read; all others meet their counts in a
join, in which no key can then hold more than that share.

Nulls: a null text is empty (just the end token); a null id counts as the empty string for the folds.
Repeated rows count and are scored each. Very long texts and words are scored whole. Columns beyond the id
and the text are ignored, whatever their names are; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import cut, few

FOLDS, HELD_OUT = 7, 2
#: A task's own counts are passed on when it holds so many words.
TASK_WORDS = 200_000
#: Longer words travel as their hash.
LONG = 32


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # on bytes both know ASCII alone


def key_of(word: bytes) -> bytes:
    return word if len(word) <= LONG else b"\0" + hashlib.blake2b(word, digest_size=16).digest()


class Lattice:
    """log10 marginal of a word over its segmentations."""

    def __init__(self, pieces: list[str], log_p: list[float]):
        import re

        self.log_p, self.byte_p = {}, [0.0] * 256
        for piece, p in zip(pieces, log_p, strict=True):
            if m := re.fullmatch("<0x(..)>", piece):
                self.byte_p[int(m[1], 16)] = p
            elif piece:
                self.log_p[piece] = p
        self.longest = max(map(len, self.log_p), default=1)

    def score(self, word: str) -> float:
        text, get, log, exp = "▁" + word, self.log_p.get, math.log, math.exp
        n, longest, forward = len(text), self.longest, [0.0]
        for end in range(1, n + 1):
            found = []
            for begin in range(max(0, end - longest), end):
                if (p := get(text[begin:end])) is not None:
                    found.append(forward[begin] + p)
            if get(text[end - 1]) is None:  # a character without a piece is spelt in bytes
                found.append(forward[end - 1] + sum(self.byte_p[x] for x in text[end - 1].encode()))
            top = max(found)
            forward.append(top if len(found) == 1 else top + log(sum([exp(x - top) for x in found])))
        return forward[n] / math.log(10)


@lru_cache(1)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        words = list(counts[0] | counts[1])
        made = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", "train", "held"])
        for c in counts:
            c.clear()
        return made

    for b in few(batches):
        for held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts[held].update(split_words(text))
            if len(counts[0]) + len(counts[1]) >= TASK_WORDS:
                yield out()
    yield out()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, train, held) over all rows (held_out, text); each task adds up its own first."""
    counted = rows.select("held_out", "text").mapInArrow(_count, "word binary, train long, held long")
    return counted.groupBy("word").agg(F.sum("train").alias("train"), F.sum("held").alias("held"))


def piece_scores(words: DataFrame, model_path: str, ends: int) -> tuple[list[str], list[float], float]:
    """Natural-log probabilities of the vocabulary's pieces and of the end token, from training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, total = _processor(model_path), Counter()
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i in sp.encode(word.decode()):
                    total[i] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    # As many rows as the vocabulary has pieces, at most.
    found = words.where("train > 0").select("word", "train").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    sp = _processor(model_path)
    counts = {r["id"]: r["n"] for r in found}
    n = sp.get_piece_size()
    total = math.log(sum(counts.values()) + ends + n + 1)
    pieces = ["" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i) for i in range(n)]
    return pieces, [math.log(counts.get(i, 0) + 1) - total for i in range(n)], math.log(ends + 1) - total


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", model_path: str | None = None, hot: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    model_path = model_path or tokens.default_path("piece_bpe_32k.model")
    held = F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    rows = docs.select(F.col(doc).alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").alias("text"))
    counts = cut(word_counts(rows))
    ends = rows.where(~F.col("held_out")).count()
    sums = counts.agg(F.sum("train"), F.sum(F.col("train") + F.col("held")), F.sum((F.col("train") > 0).cast("long"))).first()
    n, n_all, v = (sums[0] or 0) + ends, sums[1] or 0, (sums[2] or 0) + (ends > 0)
    pieces, log_p, end_p = piece_scores(counts, model_path, ends)
    shared = spark.sparkContext.broadcast((pieces, log_p))
    base = lambda c: math.log10((c + 1) / (n + 1 * (v + 1)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for b in batches:
            words, train = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in words], pa.binary()), b.column(1), b.column(2), pa.array([base(c) for c in train]), pa.array([lattice.score(w.decode()) for w in words])], names=["key", "train", "held", "base", "marginal"])

    weighed = cut(counts.mapInArrow(weigh, "key binary, train long, held long, base double, marginal double"))
    is_hot = (F.col("train") + F.col("held")) * hot >= n_all
    # `hot` rows of 32-byte words at most: counts of at least n_all / hot add up to n_all.
    often = {bytes(r["key"]): (r["train"] > 0, r["base"], r["marginal"]) for r in weighed.where(is_hot).collect()}
    often = spark.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = often.value
        for b in few(batches):
            total, known, base_sum, marginal, keys, times = [], [], [], [], [], []
            for text in b.column(2).to_pylist():
                words = Counter(split_words(text))
                k, s, m, rare, rare_n = 0, 0.0, 0.0, [], []
                for w, c in words.items():
                    key = w if len(w) <= LONG else key_of(w)
                    if (hit := known_words.get(key)) is not None:
                        k += c * hit[0]
                        s += c * hit[1]
                        m += c * hit[2]
                    else:
                        rare.append(key)
                        rare_n.append(c)
                total.append(words.total() + 1)
                known.append(k)
                base_sum.append(s)
                marginal.append(m)
                keys.append(rare)
                times.append(rare_n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(known, pa.int64()), pa.array(base_sum, pa.float64()), pa.array(marginal, pa.float64()), pa.array(keys, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "marginal", "keys", "times"],
            )

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, base double, marginal double, keys array<binary>, times array<long>"
    scored = cut(rows.mapInArrow(run, schema).withColumn("row_id", F.monotonically_increasing_id()))
    rare = scored.select("row_id", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row_id", F.col("x.keys").alias("key"), F.col("x.times").alias("c"))
    met = rare.join(weighed.where(~is_hot).select("key", (F.col("train") > 0).cast("long").alias("k"), F.col("base").alias("b"), F.col("marginal").alias("m")), "key")
    rest = met.groupBy(F.col("row_id").alias("r")).agg(F.sum(F.col("c") * F.col("k")).alias("k"), F.sum(F.col("c") * F.col("b")).alias("b"), F.sum(F.col("c") * F.col("m")).alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rest, F.col("row_id") == F.col("r"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("k") + int(ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + base(ends)).alias("base_score"), (F.col("marginal") + zero("m") + end_p / math.log(10)).alias("score"),
    )
