"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words go through the network in overlapping windows of WINDOW words, all of them; a word comes in as
its own vector and as the mean of its characters' (hashed runs of three, with its ends). Both directions' states are
pooled by learnt attention to one logit a window, and the text's score is its highest window's. A label
says that a text has a toxic part, not which: each round of training takes a toxic text's highest window as
toxic and a clean text's highest as clean, and leaves aside toxic texts in which the network has come to see nothing.

Labels come from rows whose crc32(doc_id) mod FOLDS is not HELD_OUT, at most SAMPLE toxic and 2 * SAMPLE clean ones,
at most SAMPLE_WINDOWS windows of each; the model is of bounded size. Scoring reads every word of every text where
it lies, without a shuffle. Words are ends of lower-cased letters and digits, longer than LONG in parts.

Nulls: a null text is empty and, like any text without words, scored as one window of the padding word; a null id
counts as the empty string for the folds and is never labelled. A label is toxic if any row of its id says so;
null labels are none. Repeated rows are scored each. Without toxic or without clean labels every score is the share
of toxic ones (0 without labels). Columns beyond the id and the text are ignored, whatever their names are; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, hash_sample

FOLDS, HELD_OUT = 3, 1
#: Labelled toxic rows that are learnt from at most; twice as many clean ones. Windows of each at most.
SAMPLE, SAMPLE_WINDOWS = 1500, 32
#: Words of a window, and from one window's begin to the next one's.
WINDOW, STRIDE = 48, 36
#: Vocabulary at most; buckets of character runs; characters of a word's part.
WORDS, RUNS, LONG = 8_000, 4096, 32
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 16, 12, 16, 12
STEPS, BATCH, RATE = 700, 32, 0.005
#: Windows that go through the network at a time, and words whose inputs a task remembers.
BLOCK, REMEMBERED = 512, 100_000

_WORD = re.compile(rf"\w{{1,{LONG}}}")
PADDING = "-"


def split_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower()) or [PADDING]


def runs_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' runs of three characters, ends marked, and how many each word has."""
    counts = np.fromiter(map(len, words), "i8", len(words))
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype("u8")
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) >> np.uint64(7)
    begins = np.cumsum(counts + 2) - counts - 2
    return (mixed[np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())] % RUNS).astype("i4"), counts


def window_starts(n: int) -> list[int]:
    """Of all windows of a text of n words; the last one ends with it."""
    return [*range(0, max(n - WINDOW, 0), STRIDE), max(n - WINDOW, 0)]


class Network:
    """Parameters by name; inputs are rows of word and of character vectors."""

    def __init__(self, vocabulary: list[str], seed: int = 5):
        rnd = np.random.default_rng(seed)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0 stands for all other words
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        make = lambda *shape, fan: (rnd.normal(size=shape) / math.sqrt(fan)).astype("f4")
        zero = lambda *shape: np.zeros(shape, "f4")
        self.p = {
            "word": make(len(vocabulary) + 1, WORD_DIM, fan=4 * WORD_DIM), "char": make(RUNS, CHAR_DIM, fan=CHAR_DIM),
            # Two directions; columns: update gate, reset gate, candidate.
            "x": make(2, d, 3 * h, fan=d), "x0": zero(2, 1, 3 * h), "h": make(2, h, 3 * h, fan=h), "h0": zero(2, 1, h),
            "a": make(2 * h, ATTEND, fan=2 * h), "a0": zero(ATTEND), "a1": make(ATTEND, fan=ATTEND), "o": make(2 * h, fan=2 * h), "o0": zero(1),
        }

    def inputs(self, words: list[str]) -> np.ndarray:
        """(words, WORD_DIM + CHAR_DIM)"""
        get = self.vocabulary.get
        runs, counts = runs_of(words)
        chars = np.add.reduceat(self.p["char"][runs], np.cumsum(counts) - counts) / counts[:, None].astype("f4")
        return np.hstack([self.p["word"][[get(w, 0) for w in words]], chars])

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What both directions' gates get from the inputs (words, d): (2, words, 3 * HIDDEN)."""
        return x[None] @ self.p["x"] + self.p["x0"]

    def forward(self, rows: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: rows as projected() gives them, at (time, windows) places there, mask of what is a word."""
        p, h = self.p, HIDDEN
        time, n = at.shape
        # The second direction runs from the end; its outputs are stored at their own times.
        kind = rows.dtype
        states = np.empty((time, n, 2, h), kind)
        state, x, from_state, kept = np.zeros((2, n, h), kind), np.empty((2, n, 3 * h), kind), np.empty((2, n, 3 * h), kind), []
        full = bool(mask.all())
        for t in range(time):
            np.take(rows[0], at[t], axis=0, out=x[0], mode="clip")
            np.take(rows[1], at[time - 1 - t], axis=0, out=x[1], mode="clip")
            np.matmul(state, p["h"], out=from_state)
            gates = x[..., : 2 * h] + from_state[..., : 2 * h]
            _sigmoid_within(gates)
            update, reset = gates[..., :h], gates[..., h:]
            inner = from_state[..., 2 * h :] + p["h0"]
            candidate = reset * inner
            candidate += x[..., 2 * h :]
            np.tanh(candidate, out=candidate)
            new = state - candidate
            new *= update
            new += candidate
            if not full:
                new = np.where(np.stack([mask[t], mask[time - 1 - t]])[..., None], new, state)
            if keep:
                kept.append((state, update, reset, inner, candidate))
            state = new
            states[t, :, 0], states[time - 1 - t, :, 1] = new[0], new[1]
        out = states.reshape(time, n, 2 * h)
        mid = out.reshape(-1, 2 * h) @ p["a"]
        mid += p["a0"]
        mid = np.tanh(mid, out=mid).reshape(time, n, -1)
        weight = mid @ p["a1"]
        if not full:
            weight = np.where(mask, weight, -1e9).astype(kind)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, out)
        logits = pooled @ p["o"] + p["o0"][0]
        return (logits, kept, out, mid, weight, pooled) if keep else logits

    def gradients(self, ids: np.ndarray, runs: tuple[np.ndarray, np.ndarray], at: np.ndarray, mask: np.ndarray, target: np.ndarray, trust: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients: `at` (time, windows) are places in a list of words, all of which occur, given by vocabulary places
        `ids` and by runs (those of all words, how many each has)."""
        p, h = self.p, HIDDEN
        flat, counts = runs
        begins = np.cumsum(counts) - counts
        x_words = np.hstack([p["word"][ids], np.add.reduceat(p["char"][flat], begins) / counts[:, None].astype("f4")])
        logits, kept, out, mid, weight, pooled = self.forward(self.projected(x_words), at, mask, keep=True)
        chance = _sigmoid(logits)
        loss = float(-(trust * (target * np.log(chance + 1e-7) + (1 - target) * np.log(1 - chance + 1e-7))).sum() / trust.sum())
        d_logit = (trust * (chance - target) / trust.sum()).astype("f4")
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["o0"] = d_logit @ pooled, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["o"]
        d_weight = np.einsum("nk,tnk->tn", d_pooled, out)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_mid = d_score[..., None] * p["a1"] * (1 - mid**2)
        g["a1"], g["a0"] = np.einsum("tn,tnk->k", d_score, mid), d_mid.sum(axis=(0, 1))
        g["a"] = np.einsum("tnk,tnj->kj", out, d_mid)
        d_out = weight[..., None] * d_pooled + d_mid @ p["a"].T
        time, n = mask.shape
        d_out = d_out.reshape(time, n, 2, h)
        d_state, d_x = np.zeros((2, n, h), "f4"), np.zeros((time, n, 2, 3 * h), "f4")
        h_back = p["h"].transpose(0, 2, 1)
        for t in range(time - 1, -1, -1):
            before, update, reset, inner, candidate = kept[t]
            d_new = d_state + np.stack([d_out[t, :, 0], d_out[time - 1 - t, :, 1]])
            m = np.stack([mask[t], mask[time - 1 - t]])[..., None]
            skipped, d_new = np.where(m, 0, d_new), np.where(m, d_new, 0)
            d_pre = d_new * (1 - update) * (1 - candidate**2)
            d_reset = d_pre * inner * reset * (1 - reset)
            d_update = d_new * (before - candidate) * update * (1 - update)
            g["h0"] += (d_pre * reset).sum(axis=1, keepdims=True)
            d_from = np.concatenate([d_update, d_reset, d_pre * reset], axis=-1)
            g["h"] += before.transpose(0, 2, 1) @ d_from
            d_state = d_new * update + skipped + d_from @ h_back
            d_in = np.concatenate([d_update, d_reset, d_pre], axis=-1)
            d_x[t, :, 0], d_x[time - 1 - t, :, 1] = d_in[0], d_in[1]
        g["x0"] = d_x.sum(axis=(0, 1))[:, None]
        order = np.argsort(at, axis=None, kind="stable")
        by_word = np.add.reduceat(d_x.reshape(-1, 6 * h)[order], np.searchsorted(at.ravel()[order], np.arange(len(ids)))).reshape(-1, 2, 3 * h).transpose(1, 0, 2)
        g["x"] = x_words.T[None] @ by_word
        d_input = (by_word @ p["x"].transpose(0, 2, 1)).sum(axis=0)
        np.add.at(g["word"], ids, d_input[:, :WORD_DIM])
        np.add.at(g["char"], flat, np.repeat(d_input[:, WORD_DIM:] / counts[:, None].astype("f4"), counts, axis=0))
        return loss, g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sigmoid_within(x: np.ndarray) -> None:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5


class Scorer:
    """text -> logit of its highest window, with the inputs of words remembered."""

    def __init__(self, network: Network):
        self.network, self.place, self.rows = network, {}, np.zeros((2, 0, 3 * HIDDEN), "f4")
        self.used = 0

    def places(self, words: list[str]) -> np.ndarray:
        found = list(map(self.place.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, i in zip(words, found, strict=True) if i is None))
            if self.used and self.used + len(new) > REMEMBERED:
                self.place, self.used, new = {}, 0, list(dict.fromkeys(words))
            if self.used + len(new) > self.rows.shape[1]:
                self.rows = np.concatenate([self.rows[:, : self.used], np.empty((2, self.used + len(new) + 4096, 3 * HIDDEN), "f4")], axis=1)
            self.rows[:, self.used : self.used + len(new)] = self.network.projected(self.network.inputs(new))
            self.place.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
            found = list(map(self.place.get, words))
        return np.array(found, "i4")

    def logits(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        parts: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            words = split_words(text)
            for at in range(0, max(1, len(words) - WINDOW + STRIDE), BLOCK * STRIDE):  # windows of neighbouring parts overlap as others do
                parts.append((k, words[at : at + (BLOCK - 1) * STRIDE + WINDOW]))
                size += len(parts[-1][1])
                if size >= BLOCK * WINDOW:
                    self._run(parts, best)
                    parts, size = [], 0
        if parts:
            self._run(parts, best)
        return best

    def _run(self, parts: list[tuple[int, list[str]]], best: np.ndarray) -> None:
        places = self.places([w for _, words in parts for w in words])
        starts, sizes, owner, begin = [], [], [], 0
        for k, words in parts:
            own = window_starts(len(words))
            starts += [begin + s for s in own]
            sizes += [min(WINDOW, len(words))] * len(own)
            owner += [k] * len(own)
            begin += len(words)
        starts, sizes, owner = np.array(starts), np.array(sizes), np.array(owner)
        order = np.argsort(sizes, kind="stable")  # windows of a length together
        for pick in (order[i : i + BLOCK] for i in range(0, len(order), BLOCK)):
            time = np.arange(sizes[pick].max())[:, None]
            mask = time < sizes[pick]
            np.maximum.at(best, owner[pick], self.network.forward(self.rows, places[np.where(mask, starts[pick] + time, starts[pick])], mask))


@dataclass
class Model:
    network: Network | None
    share: float

    def scores(self, scorer: Scorer | None, texts: list[str | None]) -> np.ndarray:
        if scorer is None:
            return np.full(len(texts), round(self.share, 6))
        return np.round(1 / (1 + np.exp(-np.clip(scorer.logits(texts), -30, 30))), 6)


def train(rows: list[tuple[list[list[str]], int]], steps: int = STEPS, seed: int = 5) -> Network:
    """From (windows of words, label)."""
    rnd = np.random.default_rng(seed)
    seen = Counter(w for windows, _ in rows for w in {w for window in windows for w in window})
    words = sorted(seen)
    leaning = leanings(rows, seen, words)
    ranked = sorted((-bool(x), -seen[w], w) for w, x in zip(words, leaning.tolist(), strict=True) if seen[w] > 2)
    network = Network([w for _, _, w in ranked[:WORDS]], seed)
    place = {w: i for i, w in enumerate(words)}
    ids = np.array([network.vocabulary.get(w, 0) for w in words])
    flat, counts = runs_of(words)
    runs = np.split(flat, np.cumsum(counts)[:-1])
    label = np.array([y for _, y in rows], "f4")
    network.p["word"][:, 0] = 0  # the first component begins with how far labels lean where the word stands
    network.p["word"][ids[ids > 0], 0] = leaning[ids > 0]
    at, mask, owner = [], [], []
    for k, (windows, _) in enumerate(rows):
        for window in windows:
            at.append(np.pad([place[w] for w in window], (0, WINDOW - len(window))))
            mask.append(np.arange(WINDOW) < len(window))
            owner.append(k)
    at, mask, owner = np.array(at), np.array(mask), np.array(owner)
    first, second = {k: np.zeros_like(v) for k, v in network.p.items()}, {k: np.zeros_like(v) for k, v in network.p.items()}
    step = turn = 0
    highest = np.zeros(len(rows))
    while step < steps:
        if turn:
            logits = _all_logits(network, words, at, mask)
        else:
            logits = leaning[at].max(axis=1) - 1 + 0.01 * rnd.random(len(at))
        order = np.lexsort((-logits, owner))
        nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        highest[owner[order][nth == 0]] = logits[order][nth == 0]
        # Of toxic texts the highest window, of clean ones the two highest; at first by their words' leanings.
        wanted = order[nth < np.where(label[owner[order]] > 0, 1, 2)]
        trust = np.ones(len(rows), "f4")
        trust[label > 0] = max(1.0, 0.5 * (label == 0).sum() / max((label > 0).sum(), 1))
        if step > steps // 8:
            trust[(label > 0) & (highest < 0)] = 0.02
        wanted = rnd.permutation(wanted)
        rate, turn = RATE * max(0.05, 1 - step / steps), turn + 1
        for batch in np.array_split(wanted, max(1, len(wanted) // BATCH)):
            used, where = np.unique(at[batch].T, return_inverse=True)
            own = np.where(rnd.random(len(used)) < 0.1, 0, ids[used])  # some words are known by their characters alone
            _, g = network.gradients(own, (np.concatenate([runs[i] for i in used]), counts[used]), where.reshape(at[batch].T.shape), mask[batch].T, label[owner[batch]] * 0.96 + 0.02, trust[owner[batch]])
            step += 1
            size = math.sqrt(sum(float((x**2).sum()) for x in g.values()))
            for k, x in g.items():
                x *= min(1.0, 5 / max(size, 1e-9))
                first[k] += 0.1 * (x - first[k])
                second[k] += 0.002 * (x * x - second[k])
                network.p[k] -= rate * ((first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.998**step)) + 1e-8) + (1e-3 * network.p[k] if k in ("word", "char") else 0)).astype("f4")
    return network


def leanings(rows: list[tuple[list[list[str]], int]], seen: Counter, words: list[str]) -> np.ndarray:
    """How surely a word's texts are toxic (over 0) or clean (under 0): the log odds ratio's bound nearer to 0, 0 if it spans 0."""
    toxic = Counter(w for windows, y in rows if y for w in {w for window in windows for w in window})
    n_toxic = sum(y for _, y in rows)
    a = np.array([toxic[w] for w in words], float)
    b = np.array([seen[w] for w in words]) - a
    cells = np.array([a, n_toxic - a, b, len(rows) - n_toxic - b]) + 0.5
    ratio = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])
    return (np.sign(ratio) * np.maximum(0, np.abs(ratio) - 2 * np.sqrt((1 / cells).sum(axis=0)))).astype("f4")


def _all_logits(network: Network, words: list[str], at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    rows = network.projected(network.inputs(words))
    return np.concatenate([network.forward(rows, np.ascontiguousarray(at[i : i + BLOCK].T), mask[i : i + BLOCK].T) for i in range(0, len(at), BLOCK)])


def sample_windows(text: str | None, key: int) -> list[list[str]]:
    """A text's windows, of more than SAMPLE_WINDOWS an even share."""
    words = split_words(text)
    starts = window_starts(len(words))
    if len(starts) > SAMPLE_WINDOWS:
        starts = sorted(np.random.default_rng(key & 0xFFFFFFFF).choice(starts, SAMPLE_WINDOWS, replace=False).tolist())
    return [words[s : s + WINDOW] for s in starts]


def fold_of(doc) -> F.Column:
    return F.crc32(F.coalesce(doc.cast("string"), F.lit(""))) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE, steps: int = STEPS) -> Model:
    marks = labels.select(F.col(doc).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & (fold_of(F.col("id")) != HELD_OUT))
    marks = marks.groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return Model(None, share)
    bounds = {1: most, 0: 2 * most}
    drawn = [hash_sample(marks.where(F.col("y") == y), n[y], bounds[y], "id").limit(bounds[y]) for y in bounds]
    chosen = drawn[0].unionByName(drawn[1]).select(F.col("id").alias("marked_id"), "y")  # 3 * most rows of two numbers
    texts = docs.select(F.col(doc).alias("id"), F.col(text).cast("string").alias("body")).join(F.broadcast(chosen), F.col("id") == F.col("marked_id")).select("y", "body", F.xxhash64("id", "body").alias("key"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            windows = [[" ".join(w) for w in sample_windows(t, k)] for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(windows, pa.list_(pa.string()))], names=["y", "key", "windows"])

    picked = texts.mapInArrow(pick, "y int, key long, windows array<string>").dropDuplicates(["key"])  # copies of a row teach nothing
    rows = [r for y in bounds for r in picked.where(F.col("y") == y).orderBy("key").limit(bounds[y]).collect()]
    rows.sort(key=lambda r: r["key"])
    network = train([([w.split(" ") for w in r["windows"]], r["y"]) for r in rows], steps) if len({r["y"] for r in rows}) == 2 else None
    return Model(network, share)


def score(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = model or fit(docs, labels, doc, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    doc_type = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model.network) if model.network else None
        for b in few(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.scores(scorer, b.column(2).to_pylist()))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(doc).alias("doc_id"), (fold_of(F.col(doc)) == HELD_OUT).alias("held_out"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(run, f"doc_id {doc_type}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
