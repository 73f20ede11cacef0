"""Citations [n] in answers: extraction, checks, renumbering, layout, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extracted(text: Column) -> Column:
    """The distinct numbers cited, ascending. Numbers beyond an int are none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def valid(cited: Column, n_sources: Column) -> Column:
    return F.forall(cited, lambda n: n.between(1, n_sources))


def renumbered(text: Column, n_sources: Column) -> Column:
    """Citations within range counted anew from 1 in ascending order; others stay as they are."""
    good = F.filter(extracted(text), lambda n: n.between(1, n_sources))
    pairs = F.transform(good, lambda n, i: F.struct(n.alias("old"), (i + 1).alias("new")))
    # New numbers never exceed old ones and both ascend, so that no replacement meets an earlier one's result.
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, F.concat(F.lit("["), p["old"].cast("string"), F.lit("]")), F.concat(F.lit("["), p["new"].cast("string"), F.lit("]"))))


def styled(text: Column, style: str = "numeric") -> Column:
    return F.regexp_replace(text, r"\[(\d+)\]", "($1)") if style == "academic" else text


def source_lines(sources: Column, verbose: bool = False) -> Column:
    """Numbered lines of an array of sources (file_name, page_number, section_title)."""

    def line(s: Column, i: Column) -> Column:
        number = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
        if not verbose:
            return F.concat(number, s["file_name"])
        page = F.concat(F.lit(" (page "), s["page_number"].cast("string"), F.lit(")"))
        section = F.concat(F.lit(" - "), s["section_title"])
        return F.concat(number, s["file_name"], F.coalesce(page, F.lit("")), F.coalesce(section, F.lit("")))

    return F.array_join(F.transform(sources, line), "\n")


def source_map(sources: Column) -> Column:
    return F.map_from_entries(F.transform(sources, lambda s, i: F.struct((i + 1).alias("key"), s.alias("value"))))


def statistics(answers: DataFrame) -> DataFrame:
    """answer_id, cited (distinct), mentions (all), valid, density (distinct per word). answers: answer_id, answer, n_sources."""
    cited = extracted(F.col("answer"))
    words = F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != ""))
    return answers.select(
        "answer_id", F.size(cited).alias("cited"), F.regexp_count("answer", F.lit(r"\[\d+\]")).alias("mentions"), valid(cited, F.col("n_sources")).alias("valid"),
        F.round(F.size(cited) / F.greatest(F.lit(1), words), 6).alias("density"),
    )


def usage(answers: DataFrame) -> DataFrame:
    """How many answers cite each number."""
    return answers.select(F.explode(extracted(F.col("answer"))).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("answers"))


def reference_section(sources: Column, cited: Column, style: str = "numeric") -> Column:
    """The cited ones of an array of sources, counted anew from 1, in the layout of a style; empty without any."""
    good = F.filter(cited, lambda n: n.between(1, F.size(sources)))
    entries = {"numeric": "[%d] %s", "verbose": "Source %d: %s", "academic": "(%d) %s", "minimal": "%d. %s", "footnote": "^%d %s"}
    lines = F.transform(good, lambda n, i: F.format_string(entries[style], i + 1, F.element_at(sources, n)["file_name"]))
    body = F.array_join(lines, " " if style == "minimal" else "\n")
    headed = F.concat(F.lit("References:\n"), body) if style in ("verbose", "academic") else body
    return F.when(F.size(good) == 0, "").otherwise(headed)


def replaced(text: Column, numbers: Column) -> Column:
    """Each [n] with what the map `numbers` has for n; others stay. All at once: a replacement is not replaced again."""
    parts = F.split(text, r"(?=\[\d+\])|(?<=\])")
    new = F.transform(parts, lambda p: F.coalesce(F.when(p.rlike(r"^\[\d+\]$"), F.try_element_at(numbers, F.regexp_extract(p, r"^\[(\d+)\]$", 1).try_cast("int"))), p))
    return F.array_join(new, "")
