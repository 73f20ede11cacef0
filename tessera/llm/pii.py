"""Personal data: fixed base patterns, and more spans from candidates that boosted trees select.

Generators of high recall propose overlapping spans (digit groups, dotted numbers, local parts with @,
long strings with digits, values after a naming word), of any length; each has features of its format and its
context; gradient-boosted trees score them. They are trained on examples that plants.py makes, right ones
and look-alikes, set between words of a bounded sample of the corpus' own documents, so that labels come
from how an example was made and not from its features. A fold of the examples that the trees have not
seen turns scores into probabilities. Per kind, the threshold is the lowest score from which on all
candidates of the corpus, each counted with its probability, keep the wanted precision. Base spans
always stay; selected candidates are added where they overlap none.

Nulls: a null text is an empty one, without spans; ids and repeated rows are passed through. Very long
texts and candidates are treated whole. Columns beyond the id and the text are ignored by find() and kept
by redact(), whatever their names are. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plants
from .common import SPACE_CLASS, cut, few, hash_sample

KINDS = ("email", "ip", "card", "phone", "secret")
#: Examples that trees and probabilities are fitted on; documents, and words of each, that they are set among.
SAMPLE, HOSTS, HOST_WORDS = 12_000, 300, 400
TREES, DEPTH, PRECISION = 12, 4, 0.98

# A run of a class is entered at its first character only: a match that began later would have begun there.
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL_AT, _EMAIL_ON = re.compile(_EMAIL), re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL)
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NAME = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|credential|api[_ -]?key|access[_ -]?key|private[_ -]?key|key|bearer|auth)"
#: Parts of lower-cased names, one of which each of them begins with or ends in.
_NAME_PARTS = ("token", "secret", "passw", "passphrase", "pwd", "credential", "key", "bearer", "auth")
#: What ends an address on either side.
_EDGES = frozenset("@<>()\"',;")
# High-recall generators. A pattern's first item is the characters that it begins with, which a scan skips to.
_DOTTED = re.compile(r"[0-9](?<![0-9.][0-9])[0-9]*+(?:\.[0-9]++){2,}+(?![0-9])")
_LONG = re.compile(r"[0-9](?<![0-9]{2})(?:[ ./-]?[0-9]){11,}+")
_GROUPS = re.compile(r"[0-9](?<![0-9]{2})(?:[ ().-]{0,3}[0-9]){6,}+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+")
_VALUE = re.compile(_NAME + r"[\"']?\s{0,2}(?:[:=]|\s)\s{0,2}[\"']?(?P<x>[^\s\"'<>,;]{6,}+)", re.I)
_DIGIT = re.compile("[0-9]")
_NAMED = re.compile(_NAME + r"[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$", re.I)
_CUES = tuple(re.compile(x, re.I) for x in (r"mail|contact|@", r"\bip\b|host|server|addr", r"card|visa|account|iban|credit", r"phone|tel|call|fax|mobile", _NAME))
_COUNTER_CUES = re.compile(r"commit|sha-?\d*|md5|digest|checksum|version|isbn|order|invoice|serial|uuid|https?://\S*$|[/\\]\S*$|\bv$", re.I)
#: How public kinds of keys begin.
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "SG.", "npm_", "hf_")
FEATURES = ("kind", "length", "digits", "digit_share", "upper_share", "separators", "distinct", "luhn", "octets", "hex", "plus", "domain", "named", "cue", "before", "after", "runs", "turns", "lower_share", "prefix", "assigned", "counter", "longest_word", "first_group", "groups", "brackets")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; code points, end exclusive."""
    found = []
    at = 0
    while "@" in text and (m := _EMAIL_AT.match(text, at) or _EMAIL_ON.search(text, at)):
        found.append((m.start(), 0, m.end()))
        at = m.end()
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x := g.lstrip("0")) <= 3 and int(x or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 1]
    digits = re.sub("[^0-9]", "", s)
    groups = re.findall("[0-9]+", s)
    octets = s.split(".")
    kinds = [0 if "0" <= c <= "9" else 1 if c.isalpha() else 2 for c in s]
    edge = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isalnum() else 2.0
    near = before.rstrip(" \t\"'")
    return [
        kind, len(s), len(digits), len(digits) / len(s), sum(c.isupper() for c in s) / len(s), kinds.count(2), len(set(s)),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(len(octets) == 4 and all(o.isdigit() and len(o) < 9 and int(o) <= 255 for o in octets)),
        float(re.fullmatch("[0-9a-fA-F]+", s) is not None), float(s[0] == "+" or s[:2] == "00"), float(re.search(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$", s) is not None),
        float(_NAMED.search(before) is not None), float(_CUES[kind].search(before) is not None), edge(before[-1:]), edge(after),
        len(groups), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / len(s), sum(c.islower() for c in s) / len(s),
        float(s.startswith(_PREFIXES)), float(near[-1:] in ("=", ":")), float(_COUNTER_CUES.search(before) is not None), max(map(len, re.findall("[a-z]+", s)), default=0),
        len(groups[0]) if groups else 0, len(re.split(r"[ ./-]+", s)), s.count("(") + s.count(")"),
    ]


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """What stands around each @, up to white space and signs that addresses do not hold."""
    at = text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start and not (text[start - 1] in _EDGES or text[start - 1].isspace()):
            start -= 1
        while end < len(text) and not (text[end] in _EDGES or text[end].isspace()):
            end += 1
        if start < at and end > at + 1:
            yield start, end
        at = text.find("@", end)


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Values after a naming word."""
    low = text.lower()
    if not any(part in low for part in _NAME_PARTS):
        return
    if len(low) != len(text):  # a letter whose lower case is two: places do not agree
        yield from (m.span("x") for m in _VALUE.finditer(text))
        return
    for part in _NAME_PARTS:
        at = low.find(part)
        while at >= 0:
            if m := _VALUE.match(text, at):
                yield m.span("x")
            at = low.find(part, at + 1)


def _generated(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of every generator's spans."""
    yield from ((*x, 0) for x in _addresses(text))
    if _DIGIT.search(text):
        yield from ((*m.span(), 1) for m in _DOTTED.finditer(text))
        yield from ((*m.span(), 2) for m in _LONG.finditer(text))
        for m in _GROUPS.finditer(text):
            start = m.start()
            start -= text[start - 1 : start] == "("
            yield start - (text[start - 1 : start] == "+"), m.end(), 3
        yield from ((*m.span(), 4) for m in _RUN.finditer(text))
    yield from ((*x, 4) for x in _values(text))


def candidates(text: str) -> list[tuple[int, int, int, list[float]]]:
    """(start, kind, end, features) of every generator's spans."""
    return [(start, kind, end, features(text, kind, start, end)) for start, end, kind in sorted(set(_generated(text)))]


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,kind:int,end:int,features:array<double>>>"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    wide = pa.struct([*span, pa.field("features", pa.list_(pa.float64()))])
    for b in few(batches):
        texts = [t or "" for t in b.column(1).to_pylist()]
        base = [[dict(zip(("start", "kind", "end"), x, strict=True)) for x in base_spans(t)] for t in texts]
        more = [[dict(zip(("start", "kind", "end", "features"), x, strict=True)) for x in candidates(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(wide))], names=["doc_id", "base", "found"])


def propose(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base spans and candidates with their features."""
    schema = f"doc_id {docs.schema[doc].dataType.simpleString()}, base {_SPANS}, found {_FOUND}"
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_propose, schema)


class Model:
    """Boosted trees as plain tuples, and a threshold per kind; None where a kind has no safe one."""

    def __init__(self, trees: list[tuple[float, tuple]], thresholds: list[float | None]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, f: list[float]) -> float:
        margin = 0.0
        for weight, node in self.trees:
            while len(node) == 4:
                node = node[2] if f[node[0]] <= node[1] else node[3]
            margin += weight * node[0]
        return 1 / (1 + np.exp(-2 * margin))

    def select(self, base: list[tuple[int, int, int]], found: list[tuple[int, int, int, list[float]]]) -> list[tuple[int, int, int]]:
        """base and what the model adds: best scores first, without overlaps."""
        scored = [(self.score(f), s, k, e) for s, k, e, f in found if self.thresholds[k] is not None]
        taken, begins, ends = list(base), [], []  # what is covered, in order and apart
        for s, _, e in sorted(base):
            if begins and s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                begins.append(s)
                ends.append(e)
        for p, s, k, e in sorted(scored, key=lambda x: (-x[0], x[1], x[2])):
            if p < self.thresholds[k]:
                continue
            at = bisect_right(begins, s)
            if (not at or ends[at - 1] <= s) and (at == len(begins) or e <= begins[at]):
                taken.append((s, k, e))
                begins.insert(at, s)
                ends.insert(at, e)
        return sorted(taken)


def _tree(node) -> tuple:
    if node.getClass().getSimpleName() == "LeafNode":
        return (node.prediction(),)
    split = node.split()
    return (split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def _fitted(spark: SparkSession, examples: list[tuple[list[float], float]]) -> Model:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    data = spark.createDataFrame(examples, "f array<double>, label double").coalesce(2)
    made = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=7).fit(data.select(array_to_vector("f").alias("features"), "label"))
    return Model([(w, _tree(t._call_java("rootNode"))) for w, t in zip(made.treeWeights, made.trees, strict=True)], [None] * len(KINDS))


def rising(scores: list[float], right: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities that rise with the score: steps (least score, share that is right), neighbours that fall being put together."""
    order = np.argsort(scores, kind="stable")
    steps: list[list[float]] = []  # least score, right, all
    for i in order:
        if steps and steps[-1][0] == scores[i]:
            steps[-1][1:] = [steps[-1][1] + right[i], steps[-1][2] + 1]
        else:
            steps.append([scores[i], right[i], 1])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1][1:] = [steps[-1][1] + last[1], steps[-1][2] + last[2]]
    return np.array([x[0] for x in steps]), np.array([x[1] / x[2] for x in steps])


def _counts(flat: DataFrame, model: Model) -> dict[int, list[tuple[float, int]]]:
    """Per kind, (score, candidates) of the whole corpus, best scores first. Trees have few distinct scores."""
    held = flat.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, float], int] = {}
        for b in few(batches):
            for f in b.column(0).to_pylist():
                at = int(f[0]), float(held.value.score(f))
                found[at] = found.get(at, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([p for _, p in found], pa.float64()), pa.array(list(found.values()), pa.int64())], names=["kind", "score", "n"])

    summed = flat.select("features").mapInArrow(run, "kind int, score double, n long").groupBy("kind", "score").agg(F.sum("n").alias("n"))
    out: dict[int, list[tuple[float, int]]] = {}
    for x in sorted(summed.collect(), key=lambda x: -x["score"]):
        out.setdefault(x["kind"], []).append((x["score"], x["n"]))
    return out


def hosts(docs: DataFrame, text: str, n: int, most: int = HOSTS) -> list[list[str]]:
    """Words of about `most` of n documents, an even share by the text's hash; of each, HOST_WORDS at most."""
    some = hash_sample(docs.select(F.col(text).cast("string").alias("t")).where("t IS NOT NULL"), n, most, "t")
    rows = some.select("h", F.slice(F.split("t", SPACE_CLASS + "+"), 1, HOST_WORDS).alias("words")).dropDuplicates(["h"]).collect()
    return [r["words"] for r in sorted(rows, key=lambda r: r["h"])][: 2 * most]


def examples(host_words: list[list[str]], sample: int = SAMPLE) -> list[tuple[list[float], float]]:
    """(features, label) of planted spans as the generators propose them, kinds and labels in turn."""
    made = []
    for before, span, after, kind, right in plants.plant(host_words, sample, len(KINDS)):
        t = f"{before}{span}{after}"
        at = len(before), len(before) + len(span)
        made += [(list(map(float, f)), float(right)) for start, k, end, f in candidates(t) if k == kind and start < at[1] and end > at[0] and (not right or (start, end) == at)]
    return made


def train(proposed: DataFrame, docs: DataFrame, text: str = "text", sample: int = SAMPLE, precision: float = PRECISION) -> Model:
    """Fit on `sample` planted examples, two thirds for the trees and one for probabilities; thresholds from all candidates."""
    made = examples(hosts(docs, text, proposed.count()), sample)
    model = _fitted(proposed.sparkSession, [x for i, x in enumerate(made) if i % 3])
    flat = proposed.select(F.explode("found").alias("x")).select("x.features")
    for kind, scores in _counts(flat, model).items():
        unseen = [(float(model.score(f)), y) for i, (f, y) in enumerate(made) if i % 3 == 0 and int(f[0]) == kind]
        steps, share = rising([p for p, _ in unseen], [y for _, y in unseen])
        right = every = 0.0
        for p, n in scores:
            at = np.searchsorted(steps, p, "right") - 1
            chance = float(share[at]) if at >= 0 else 0.0
            right, every = right + chance * n, every + n
            if right / every >= precision and chance > 0.5:
                model.thresholds[kind] = p
    return model


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_added, n_spans."""
    proposed = cut(propose(docs, doc, text))
    model = docs.sparkSession.sparkContext.broadcast(train(proposed, docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            counts, digest, spans, secret, added, total = [[], [], [], []], [], [], [], [], []
            for base, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = [(x["start"], x["kind"], x["end"]) for x in base]
                every = model.value.select(own, [(x["start"], x["kind"], x["end"], x["features"]) for x in found])
                for k, n in enumerate(counts):
                    n.append(sum(x[1] == k for x in own))
                digest.append(hashlib.sha256(_text_of(own).encode()).hexdigest())
                spans.append(_text_of(every))
                secret.append(sum(x[1] == 4 for x in every))
                added.append(len(every) - len(own))
                total.append(len(every))
            longs = [pa.array(x, pa.int64()) for x in (*counts, secret, added, total)]
            yield pa.RecordBatch.from_arrays([b.column(0), *longs[:4], pa.array(digest, pa.string()), pa.array(spans, pa.string()), *longs[4:]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_added", "n_spans"])

    return proposed.mapInArrow(run, f"doc_id {proposed.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_added long, n_spans long")


def redact(docs: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """docs with every found span replaced by its kind in brackets; null texts stay null.

    Texts are read three times, to propose, to sample and to redact, and never shuffled."""
    only = docs.select(F.lit(0).alias("n"), F.col(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(cut(propose(only, "n", "text").drop("doc_id", "base")), only))
    at = docs.columns.index(text)

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        out, done = [], 0
        for start, kind, end in model.value.select(base_spans(t), candidates(t)):
            if start >= done:
                out += [t[done:start], mark.format(KINDS[kind].upper())]
            done = max(done, end)
        return "".join([*out, t[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            yield b.set_column(at, text, pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)
