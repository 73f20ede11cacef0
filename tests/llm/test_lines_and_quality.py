import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, quality_rules

from .fixtures import awkward, rows_of, table


def plain_lines(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rank = lambda i: -1 if i is None else i
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(rank(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or rank(i) == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clashing", [False, True])
def test_line_dedup_matches_plain_python(spark, clashing):
    found = line_dedup.line_dedup(table(spark, clashing=clashing))
    assert rows_of(found.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))) == plain_lines(awkward())


def test_a_line_over_many_ranges(spark):
    hot = [(i, f"the very same line in each of them\nown line number {i} of this text", "en", "s", 1) for i in range(4000)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = line_dedup.line_dedup(table(spark, hot).repartition(16))
        assert rows_of(found.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))) == plain_lines(hot)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_drop_lines_keeps_columns_and_nulls(spark):
    docs = table(spark, clashing=True)
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text IS NULL").count() == 1


def test_empty_tables(spark):
    assert line_dedup.line_dedup(table(spark, [])).count() == 0
    assert quality_rules.quality_rules(table(spark, [])).count() == 0
    assert quality_rules.keep_good(table(spark, [])).count() == 0


def plain_measures(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {p for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked), failed


@pytest.mark.parametrize("clashing", [False, True])
def test_quality_measures(spark, clashing):
    out = quality_rules.quality_rules(table(spark, clashing=clashing))
    got = rows_of(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == sorted([(i, *plain_measures(t)) for i, t, *_ in awkward()], key=repr)


def test_boilerplate_goes_and_copies_stay(spark):
    own = lambda i: " ".join(f"v{i}x{k}" for k in range(25))
    menu = " ".join(f"menu{k}" for k in range(30))
    rows = [(i, f"{own(i)}\n{menu}\n{own(i + 1000)}", "en", "a", 0) for i in range(60)]
    rows += [(100 + i, f"{own(i + 5000)[:9]}\n{menu}\n{'tiny %d' % i}", "en", "a", 0) for i in range(30)]
    copy = own(9000) + "\n" + own(9001) + "\n" + own(9002)
    rows += [(200 + i, copy, "en", "a", 0) for i in range(60)]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert all(out[i]["n_removed_lines"] == 1 and out[i]["kept"] for i in range(60))
    assert all(not out[100 + i]["kept"] and not out[100 + i]["base_failed"] for i in range(30))
    assert all(out[200 + i]["kept"] for i in range(60))


def test_a_block_of_fixed_lines_goes_whole(spark):
    own = lambda i: " ".join(f"v{i}x{k}" for k in range(25))
    block = "\n".join(" ".join(f"block{j}x{k}" for k in range(30)) for j in range(4))
    rows = [(i, f"{block}\n{own(i)}", "en", "a", 0) for i in range(30)] + [(100 + i, f"{own(100 + i)}\n{block}", "en", "a", 0) for i in range(30)]
    copy = "\n".join(map(own, range(9000, 9004)))
    rows += [(200 + i, copy, "en", "a", 0) for i in range(60)]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert all(out[i]["n_removed_lines"] == 4 and out[i]["n_removed_words"] == 120 and not out[i]["kept"] and not out[i]["base_failed"] for i in out if i < 200)
    assert all(out[200 + i]["kept"] and out[200 + i]["n_removed_lines"] == 0 for i in range(60))


def test_keep_good_returns_rows_unchanged(spark):
    docs = table(spark, clashing=True)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = [r for r in awkward() if not plain_measures(r[1])[-1]]
    assert rows_of(kept.select("doc_id", "text", "lang", "source", "n_chars")) == sorted(want, key=repr)
