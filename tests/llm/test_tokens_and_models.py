import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe_transducer, lattice_lm, multi_index, packing, pii, registry, token_rollup, tokens

from .fixtures import awkward, rows_of, table, words

P = pytest.importorskip("public_tokenizers")


def reference_encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={}).encode_ordinary


@pytest.mark.parametrize("clashing", [False, True])
def test_bpe_round_trip(spark, clashing):
    encode = reference_encoder()
    out = rows_of(bpe_transducer.digests(table(spark, clashing=clashing)))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := encode(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in awkward()]
    assert out == sorted(want, key=repr)


def test_transducer_equals_reference_on_noise():
    encode, codec, rnd = reference_encoder(), bpe_transducer.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(2)
    for _ in range(1500):
        s = "".join(rnd.choice("abcdefg hij  \n\t'sTé漢😀0123²½!?#     the ing <|endoftext|>") for _ in range(rnd.randint(0, 80)))
        ids = codec.encode(s)
        assert ids == encode(s) and codec.decode(ids) == s
    codec.transducer.most_states = 10  # starting over changes nothing
    assert codec.transducer.encode(b" unbelievablythorough") == encode(" unbelievablythorough")


def test_digests_of_an_empty_table(spark):
    assert bpe_transducer.digests(table(spark, [])).count() == 0


def test_a_pattern_that_splits_words_is_followed(spark):
    import regex

    pattern = r"\p{Lu}\p{Ll}*| ?\p{Ll}+|\s+|[^\s\p{L}]+"
    codec, encode = bpe_transducer.codec(P.path("byte_bpe_50k.tiktoken"), pattern), reference_encoder()
    text = " someWordsWith caseInside 12 x"
    assert codec.encode(text) == [i for piece in regex.findall(pattern, text) for i in encode(piece)]


def test_encode_and_decode_columns(spark):
    out = bpe_transducer.decode(bpe_transducer.encode(table(spark))).select("text", "decoded").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in out)


@pytest.mark.parametrize("clashing", [False, True])
def test_packing_is_exact(spark, clashing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = packing.pack_documents(table(spark, clashing=clashing)).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    want = Counter()
    for i, t, *_ in awkward():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = piece = 0
        while at < len(ids):
            n = (len(ids) - at) % 1024 or 1024
            want[i, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at, piece = at + n, piece + 1
    assert got == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_plans_are_valid_and_near_the_bound():
    rnd = np.random.default_rng(1)
    for capacity, n in ((10, 40), (100, 3000), (1024, 5000)):
        lengths = rnd.integers(1, capacity + 1, n)
        histogram = dict(zip(*map(lambda x: x.tolist(), np.unique(lengths, return_counts=True)), strict=True))
        counts = np.zeros(capacity + 1, "i8")
        for k, v in histogram.items():
            counts[k] = v
        sets = [*packing.reduce(counts, capacity), *packing.best_fit(counts, capacity)]
        used = Counter()
        for items, times in sets:
            assert sum(items) <= capacity and times > 0
            for x in items:
                used[x] += times
        assert used == Counter(histogram)
        bound = max(math.ceil(lengths.sum() / capacity), int((lengths * 2 > capacity).sum()))
        assert sum(t for _, t in sets) <= bound * 1.02 + 1


def test_reduction_keeps_the_optimum():
    def best(items, capacity):
        items = sorted(items, reverse=True)
        least = len(items)

        def go(k, bins):
            nonlocal least
            if len(bins) >= least:
                return
            if k == len(items):
                least = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                    go(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
            go(k + 1, [*bins, items[k]])

        go(0, [])
        return least

    rnd = random.Random(8)
    for _ in range(200):
        items = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
        counts = np.bincount(items, minlength=21).astype("i8")
        fixed = sum(t for _, t in packing.reduce(counts, 20))
        assert fixed + best(np.repeat(np.arange(21), counts).tolist(), 20) == best(items, 20)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(3)
    for _ in range(20000):
        t = "".join(rnd.choice("a@b.-_1234567890 +().%") for _ in range(rnd.randint(0, 50)))
        assert plain_spans(t) == pii.base_spans(t), t
    pii.base_spans("1" * 200_000 + "." * 10 + "a" * 200_000 + "@")  # in linear time


@pytest.mark.parametrize("clashing", [False, True])
def test_pii_keeps_base_spans(spark, clashing):
    out = pii.find(table(spark, clashing=clashing)).collect()
    assert len(out) == len(awkward())
    for r in out:
        text = next((t for i, t, *_ in awkward() if i == r["doc_id"]), None) or ""
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(text))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert pii.find(table(spark, [])).count() == 0


def test_trained_spans_find_secrets_and_leave_prose_alone(spark):
    rnd = random.Random(4)
    hexes = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    prose = lambda: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(60))
    rows = [(i, f'{prose()} token = "{hexes()}" {prose()}' if i % 3 == 0 else f"{prose()} {'x' * 30}{prose()} 192.168.1.{i % 300}", "en", "s", 0) for i in range(600)]
    out = {r["doc_id"]: r["spans"] for r in pii.find(table(spark, rows)).collect()}
    found = [("secret" in out[i]) == (i % 3 == 0) for i, *_ in rows]
    assert sum(found) >= 0.97 * len(rows)
    cleaned = pii.redact(table(spark, rows, clashing=True)).collect()
    assert all("192.168.1." not in r["text"] for r in cleaned if r["doc_id"] % 300 <= 255 and r["doc_id"] % 3)


def test_a_rare_kind_has_a_threshold_beside_a_frequent_one(spark):
    rnd = random.Random(6)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    hexes = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, " and ".join(digits(rnd.choice((15, 16, 17))) for _ in range(20)), "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, f'token = "{hexes()}"', "en", "s", 0) for i in range(6)]
    docs = table(spark, rows)
    model = pii.train(pii.propose(docs), docs)
    assert model.thresholds[4] is not None
    assert all(any(k == 4 for _, k, _ in model.select([], pii.candidates(t))) for i, t, *_ in rows if i >= 1000)


def test_added_spans_are_the_planted_ones(spark):
    """Formats that the corpus has and the training examples do not come from: each is found whole, look-alikes are left."""
    rnd = random.Random(8)
    prose = lambda: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(30))
    some = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    upper, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    secrets = [lambda: ("", "AKIA" + some(upper, 16)), lambda: ("password=", some(hexes, 18)), lambda: ('token = "', some(hexes, 40)), lambda: ("api_key: ", some(upper.lower() + upper, 320))]
    clean = [lambda: ("commit ", some(hexes, 40)), lambda: ("order ", "1" + some("0123456789", 12)), lambda: ("", "2021-03-04"), lambda: ("", "heitlichkeitenverbindlich"), lambda: ("the key ", "moment")]
    rows, want = [], {}
    for i in range(600):
        before, span = (secrets[i % 4] if i % 2 else clean[i // 2 % 5])()
        head = f"{prose()} {before}"
        rows.append((i, f"{head}{span}{chr(34) if before.endswith(chr(34)) else ''} {prose()}", "en", "s", 0))
        if i % 2:
            want[i] = f"secret:{len(head)}:{len(head) + len(span)}"
    out = {r["doc_id"]: r for r in pii.find(table(spark, rows)).collect()}
    hit = sum(want[i] in out[i]["spans"].split(",") for i in want)
    wrong = sum(out[i]["n_added"] > 0 for i in out if i not in want)
    assert hit >= 0.95 * len(want) and wrong <= 0.02 * len(rows)
    assert all(r["n_spans"] == len(list(filter(None, r["spans"].split(",")))) for r in out.values())


def test_probabilities_rise():
    at, share = pii.rising([0.1, 0.2, 0.2, 0.3, 0.4, 0.5], [0, 1, 0, 0, 1, 1])
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all() and share[0] == 0 and share[-1] == 1


def test_long_secrets_and_local_parts_are_proposed_whole():
    for kind, text in ((4, "a1" * 400), (0, "b" * 90 + "@example.com"), (0, "a@" + "c" * 200 + ".org"), (0, "1" * 5000 + ".1.2@3.4")):
        assert (0, kind, len(text)) in [x[:3] for x in pii.candidates(text)]


def test_lattice_sums_over_all_segmentations():
    pieces, p = ["▁", "a", "b", "ab", "▁a", "ba", "<0xC3>", "<0xA9>"], [0.1, 0.2, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]
    lattice = lattice_lm.Lattice(pieces, [math.log(x) for x in p])
    prob = dict(zip(pieces, p, strict=True)) | {"é": 0.05 * 0.05}

    def brute(s):
        return 1.0 if not s else sum(prob[s[:k]] * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in prob)

    for w in ("a", "ab", "abab", "baé", "aabba"):
        assert lattice.score(w) == pytest.approx(math.log10(brute("▁" + w)))


@pytest.mark.parametrize(("clashing", "hot"), [(False, 100_000), (True, 5)])
def test_base_score(spark, clashing, hot):
    out = lattice_lm.score(table(spark, clashing=clashing), hot=hot).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    for i, t, *_ in awkward():
        if not held(i):
            c.update([*words(t), "END"])
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(w := [*words(t), "END"]), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t, *_ in awkward()), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out), key=repr) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in out)
    assert lattice_lm.score(table(spark, [])).count() == 0


def test_scores_equal_sums_over_all_segmentations(spark):
    """Whole rows against brute force: pieces counted anew, every segmentation of every word listed."""
    import math
    import zlib
    from collections import Counter
    from itertools import product

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["a cat sat", "The cats", "", None, "dog é sat a", "sat sat on on", "cats and dogs", "zq"])]
    out = {r["doc_id"]: r for r in lattice_lm.score(table(spark, rows)).collect()}
    split = lambda t: (t or "").lower().split()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    counts, ends = Counter(), sum(not h for h in held.values())
    for i, t, *_ in rows:
        for w in split(t) if not held[i] else ():
            counts.update(sp.encode(w))
    total = sum(counts.values()) + ends + sp.get_piece_size() + 1
    p = {sp.id_to_piece(k): (counts[k] + 1) / total for k in range(sp.get_piece_size()) if not sp.is_control(k) and not sp.is_unknown(k)}

    def marginal(word):
        text, found = "\u2581" + word, 0.0
        for cuts in product((0, 1), repeat=len(text) - 1):
            parts, begin = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[begin:k])
                    begin = k
            parts.append(text[begin:])
            chance = 1.0
            for part in parts:
                if part in p:
                    chance *= p[part]
                elif len(part) == 1:
                    for byte in part.encode():
                        chance *= p[f"<0x{byte:02X}>"]
                else:
                    chance = 0.0
            found += chance
        return math.log10(found)

    for i, t, *_ in rows:
        want = sum(map(marginal, split(t))) + math.log10((ends + 1) / total)
        assert out[i]["held_out"] == held[i] and abs(out[i]["score"] - want) < 1e-9


def test_hot_and_rare_words_score_alike(spark):
    a, b = ({(r["doc_id"], r["n_tokens"]): round(r["score"], 6) for r in lattice_lm.score(table(spark), hot=h).collect()} for h in (100_000, 3))
    assert a == b


def vectors(spark, n, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 16)).astype("f4")
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [float("inf")] + [1.0] * 15), (5080, [None] + [1.0] * 15)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_multi_index_recall(spark):
    x, df = vectors(spark, 3000)
    out = multi_index.search(df, df.where("vec_id % 20 = 0")).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype("f8")
    hit = 0
    for i in range(0, 3000, 20):
        s = d @ d[i]
        s[i] = -np.inf
        best = set(np.lexsort((np.arange(3000), -s))[:20].tolist())
        rows = sorted(got[i])
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(abs(sc - s[v]) < 1e-9 for _, v, sc in rows) and [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        hit += len(best & {v for _, v, _ in rows})
    assert set(got) == set(range(0, 3000, 20)) and hit / (20 * 150) >= 0.9


def plain_nearest(vectors, query, top=20):
    width = max(map(len, vectors.values()))
    pad = lambda v: np.pad(np.array(v, "f8"), (0, width - len(v)))
    scored = sorted((-float(pad(v) @ pad(vectors[query])), i) for i, v in vectors.items() if i != query)
    return [i for _, i in scored[:top]]


@pytest.mark.parametrize("sizes", [(1,), (2, 5), (1, 3, 8)])
def test_vectors_of_any_dimension_take_part(spark, sizes):
    rnd = np.random.default_rng(5)
    rows = {i: [float(np.float32(x)) for x in rnd.normal(size=sizes[i % len(sizes)])] for i in range(60)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "cell", "h", "shard", "block", "query_id", "depth")})
    got = {}
    for r in multi_index.search(df, df.where("vec_id % 20 = 0"), recall=1.0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: plain_nearest(rows, q) for q in (0, 20, 40)}


def test_clustered_vectors_need_a_small_share(spark):
    rnd = np.random.default_rng(9)
    centers = rnd.normal(size=(40, 16)) * 6
    x = (centers[rnd.integers(0, 40, 8000)] + rnd.normal(size=(8000, 16))).astype("f4")
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(8000)], "vec_id long, embedding array<float>")
    books = tuple(multi_index.kmeans(h.astype("f8"), 22) for h in (x[:, :8], x[:, 8:]))
    cell = multi_index.assign(x[:, :8], books[0]) * 22 + multi_index.assign(x[:, 8:], books[1])
    counts = np.bincount(cell, minlength=22 * 22)
    asked = [(i, x[i].tolist()) for i in range(0, 8000, 100)]
    true = {}
    for i, v in asked:
        s = x.astype("f8") @ np.array(v)
        s[i] = -np.inf
        true[i] = cell[np.argsort(-s)[:20]].tolist()
    assert multi_index.depth(books, counts, asked, true, 16, 0.94) < 0.15 * 8000
    assert multi_index.search(df, df.where("vec_id % 400 = 0")).count() == 20 * 20


def test_repeated_query_rows_are_asked_once(spark):
    df = spark.createDataFrame([(i % 30, [float(i % 7) + 1, 1.0, float(i % 5)]) for i in range(60)], "vec_id long, embedding array<float>")
    out = multi_index.search(df, df.where("vec_id = 0")).collect()
    assert len(out) == 20 and all(r["vec_id"] != 0 for r in out)


def test_multi_index_ties_and_few_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 0.5, 0.25, 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    out = multi_index.search(same, same.where("vec_id = 20"), centroids=4).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [i for i in range(21) if i != 20]
    few = same.where("vec_id < 3")
    assert multi_index.search(few, few.where("vec_id = 0"), centroids=4).count() == 2
    assert multi_index.search(same.limit(0), same.limit(0)).count() == 0


def test_shards_cover_every_cell():
    counts = np.array([0, 10, 20_000, 3, 8192, 0, 8193])
    first, parts = multi_index.shards_of(counts)
    room = Counter()
    for c in np.flatnonzero(counts):
        for s in range(first[c], first[c] + max(1, parts[c])):
            room[s] += -(-int(counts[c]) // max(1, int(parts[c])))
    assert max(room.values()) <= multi_index.SHARD_ROWS


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    schema = "op string, doc_id long, source string, lang string, version string, tokens long"
    change = lambda *rows: spark.createDataFrame(rows, schema)
    assert r.totals().count() == 0
    first = change(("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5), ("insert", 3, "b", None, "v1", None), ("insert", 1, "a", "en", "v2", 12))
    assert r.commit(1, first) and not r.commit(1, first)
    assert rows_of(r.totals()) == sorted([("a", "en", "v1", 2, 15), ("b", None, "v1", 1, 0), ("a", "en", "v2", 1, 12)], key=repr)
    assert r.commit(2, change(("delete", 2, None, None, "v1", None), ("revise", 1, "b", "en", "v1", 11), ("delete", 99, "a", "en", "v1", 4), ("insert", 4, "a", "en", "v1", 7), ("insert", 4, "a", "en", "v1", 7)))
    assert rows_of(r.totals()) == sorted([("a", "en", "v1", 1, 7), ("b", "en", "v1", 1, 11), ("b", None, "v1", 1, 0), ("a", "en", "v2", 1, 12)], key=repr)
    with pytest.raises(ValueError):
        r.commit(0, first)
    assert r.commit(3, change(("delete", 4, None, None, "v1", None), ("insert", 2, "a", "en", "v1", 6)))
    assert ("a", "en", "v1", 1, 6) in rows_of(r.totals())


def plain_totals():
    encode, totals = reference_encoder(), {}
    last = {}
    for i, t, lang, source, *_ in awkward():
        last[(i, None if i is not None else t)] = (source, lang, len(encode(t or "")))
    for source, lang, n in last.values():
        docs, tokens_ = totals.get((source, lang), (0, 0))
        totals[source, lang] = (docs + 1, tokens_ + n)
    return sorted([(*k, "byte_bpe_50k", *v) for k, v in totals.items()], key=repr)


def test_token_counts_of_awkward_documents(spark, tmp_path):
    encode = reference_encoder()
    counted = token_rollup.count_tokens(table(spark, clashing=True))
    assert sorted((r["doc_id"], r["tokens"]) for r in counted.collect() if r["doc_id"] is not None) == sorted((i, len(encode(t or ""))) for i, t, *_ in awkward() if i is not None)
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    r.commit(1, counted.withColumn("op", F.lit("insert")))
    assert rows_of(r.totals()) == plain_totals()
    assert r.commit(2, counted.limit(0).withColumn("op", F.lit("insert")))
    assert rows_of(r.totals()) == plain_totals()


def test_rollup_query_ends_with_the_plain_totals(spark, tmp_path):
    table(spark, clashing=False).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(registry.op2_token_rollup(spark, str(tmp_path))) == plain_totals()


def test_added_tokens_are_single_ids():
    added = tokens.added_tokens(P.path("byte_bpe_50k.json"))
    ids = tokens.id_bytes(P.path("byte_bpe_50k.tiktoken"), added)("x<|endoftext|>")
    assert len(ids) == 8 and int.from_bytes(ids[4:], "little") == 50256


def test_rollup_knows_its_ops_and_compacts(spark, tmp_path, monkeypatch):
    schema = "op string, doc_id long, source string, lang string, version string, tokens long"
    change = lambda *rows: spark.createDataFrame([(op, i, "s", "en", "v", n) for op, i, n in rows], schema)
    r = token_rollup.Rollup(spark, str(tmp_path / "ops"))
    r.commit(1, change(("revise", 1, 5), (None, 2, 7), ("bogus", 3, 9), ("delete", 4, 1)))
    assert rows_of(r.totals()) == [("s", "en", "v", 1, 5)]
    monkeypatch.setattr(token_rollup, "COMPACT_AFTER", 3)
    r, plain, rnd = token_rollup.Rollup(spark, str(tmp_path / "many")), {}, random.Random(4)
    for batch in range(9):
        rows = [(rnd.choice(["insert", "revise", "delete"]), i, rnd.randrange(100)) for i in rnd.sample(range(12), 5)]
        r.commit(batch, change(*rows))
        assert not r.commit(batch, change(("insert", 99, 1)))
        for op, i, n in rows:
            plain.pop(i, None) if op == "delete" else plain.update({i: n})
        want = [("s", "en", "v", len(plain), sum(plain.values()))] if plain else []
        assert rows_of(r.totals()) == want and {x["doc_id"]: x["tokens"] for x in r.ledger().collect()} == plain
    assert r.batches("compactions") and r._read("changes", token_rollup._LEDGER).inputFiles()
    before = rows_of(r.totals())
    r.compact()
    r.compact()
    assert rows_of(r.totals()) == before and len(r._read("deltas", token_rollup._DELTA).select("batch").distinct().collect()) <= 1


def test_plans_do_not_grow_with_the_documents():
    for shape in ({500: 1, 260: 2}, {342: 3, 399: 1, 500: 2, 559: 1}, {340: 5, 345: 2, 350: 1}):
        rows = [len(packing.plan({k: v * n for k, v in shape.items()}, 1024)) for n in (1_000, 8_000, 64_000)]
        assert max(rows) <= rows[0] + 40, (shape, rows)


@pytest.mark.parametrize("rows", [[(3, [1.0, 2.0])] * 30_000, [(0, [0.1 * (i % 7), 1.0]) for i in range(30_000)]])
def test_sample_of_one_id_is_bounded(spark, rows, monkeypatch):
    monkeypatch.setattr(multi_index, "SAMPLE", 500)
    taken = []
    monkeypatch.setattr(multi_index, "kmeans", lambda x, k, rounds=10, old=multi_index.kmeans: taken.append(len(x)) or old(x, k, rounds))
    table_ = spark.createDataFrame([*rows, (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    out = multi_index.search(table_, table_.where("vec_id = 7"), top=5).collect()
    assert len(out) == 5 and max(taken) <= 500 and min(taken) > 0


def test_selected_spans_do_not_meet():
    rnd = random.Random(6)
    model = pii.Model([], [0.2] * len(pii.KINDS))
    model.score = lambda f: f[0]
    for _ in range(200):
        span = lambda: (s := rnd.randrange(80), rnd.randrange(len(pii.KINDS)), s + rnd.randrange(1, 12))
        base, found = [span() for _ in range(3)], [(*span(), [rnd.random()]) for _ in range(30)]
        taken = list(base)
        for s, k, e, f in sorted(found, key=lambda x: (-x[3][0], x[0], x[1])):
            if f[0] >= 0.2 and all(e <= s2 or e2 <= s for s2, _, e2 in taken):
                taken.append((s, k, e))
        assert model.select(base, found) == sorted(taken)
