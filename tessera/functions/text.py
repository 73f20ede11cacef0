"""Cleaning, normalising and splitting of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import greedy, let, runs

# Fixed values of the text rules.
ABBREVIATIONS = ["Dr.", "Mr.", "Mrs.", "Ms.", "Jr.", "Sr.", "Prof.", "Inc.", "Ltd.", "Corp.", "Co.", "vs.", "etc.", "e.g.", "i.e.", "Ph.D.", "M.D.", "B.A.", "M.A.", "U.S.", "U.K."]
BULLETS = "•◦▪▫⬩▹▸►▻→"
DOUBLE_QUOTES, SINGLE_QUOTES = "“”«»", "‘’‹›"
PAGE_LINES = (r"page \d+ of \d+$", r"\d+/\d+$", "header:", "draft", "confidential")
FOOT_LINES = ("copyright ©", "all rights reserved", "footer:", r"\d{4} .+ inc\.")
URLS = r"https?://[^\s]+"
EMAILS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONES = r"\+?\d{1,3}?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
#: As SENTENCE_END, but not behind an abbreviation.
SENTENCE_GAP = r"(?<=[.!?])(?<!" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\s+(?=[A-Z])"
#: What \s stands for.
SPACES = " \t\n\x0b\f\r"


def _c(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


@F.pandas_udf(T.StringType())
def nfc(texts):
    """Canonical composition; not among Spark's own functions."""
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def html_unescaped(texts):
    import html

    return texts.map(lambda t: None if t is None else html.unescape(t))


def without_tags(text) -> Column:
    return F.regexp_replace(_c(text), r"<[^>]+>", "")


def plain_quotes(text) -> Column:
    return F.translate(_c(text), DOUBLE_QUOTES + SINGLE_QUOTES, '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES))


def plain_bullets(text) -> Column:
    return F.translate(_c(text), BULLETS, "•" * len(BULLETS))


def clean(text, urls: bool = False, emails: bool = False, phones: bool = False, html: bool = True, unicode: bool = False, quotes: bool = True, bullets: bool = True, spaces: bool = True, newlines: bool = True, lower: bool = False, lines: bool = True) -> Column:
    """The cleaning chain, in order. The first three flags put a space for what they name; html drops tags and
    resolves entities; lines keeps line breaks when spaces are squeezed. Null stays null."""
    t = _c(text)
    if html:
        t = html_unescaped(without_tags(t))
    for on, pattern in ((urls, URLS), (emails, EMAILS), (phones, PHONES)):
        if on:
            t = F.regexp_replace(t, pattern, " ")
    if unicode:
        t = nfc(t)
    if quotes:
        t = plain_quotes(t)
    if bullets:
        t = plain_bullets(t)
    if spaces:
        t = F.regexp_replace(t, r"[^\S\n]+" if lines else r"\s+", " ")
    if newlines:
        t = F.regexp_replace(t, r"\n\s*\n\s*\n+", "\n\n")
    if lower:
        t = F.lower(t)
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def clean_for_retrieval(text) -> Column:
    return clean(text)


def _lines(text) -> Column:
    return F.split(_c(text), "\n")


def _begins(line: Column, patterns: tuple[str, ...]) -> Column:
    return line.rlike("(?i)^(" + "|".join(patterns) + ")")


def without_boilerplate(text, headers: bool = True, footers: bool = True, page_numbers: bool = True) -> Column:
    """Without lines that are page numbers, running heads or feet."""

    def stays(line: Column) -> Column:
        bare = F.trim(line)
        ok = F.lit(True)
        if page_numbers:
            ok = ok & ~bare.rlike(r"^\d+$")
        if headers:
            ok = ok & ~_begins(bare, PAGE_LINES)
        if footers:
            ok = ok & ~_begins(bare, FOOT_LINES)
        return ok

    return F.array_join(F.filter(_lines(text), stays), "\n")


def distinct_lines(text) -> Column:
    return F.array_join(F.array_distinct(_lines(text)), "\n")


def marked_structure(text) -> Column:
    """[HEADER] before short lines in capitals, [LIST] before list items."""

    def mark(line: Column) -> Column:
        bare = F.trim(line)
        capital = (F.upper(bare) == bare) & (F.lower(bare) != bare) & (F.length(bare) < 100)
        return F.when(capital, F.concat(F.lit("[HEADER] "), line)).when(bare.rlike(r"^[\d•\-*]\s"), F.concat(F.lit("[LIST] "), line)).otherwise(line)

    return F.array_join(F.transform(_lines(text), mark), "\n")


def truncated(text, length: int, suffix: str = "...", whole_words: bool = True) -> Column:
    t = _c(text)
    head = F.substring(t, 1, length - len(suffix))
    if whole_words:
        head = F.when(F.instr(F.substring(head, 2, length), " ") > 0, F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    return F.when(F.length(t) <= length, t).otherwise(F.concat(head, F.lit(suffix)))


def without_special(text, punctuation: bool = True, numbers: bool = True) -> Column:
    keep = "a-zA-Z" + ("0-9" if numbers else "") + r"\s" + (r".,!?;:'\-" if punctuation else "")
    return F.regexp_replace(_c(text), f"[^{keep}]", "")


def sentences(text) -> Column:
    """Sentences as an array; full stops of known abbreviations do not end one."""
    parts = F.transform(F.split(F.coalesce(_c(text), F.lit("")), SENTENCE_GAP), lambda s: F.btrim(s, F.lit(SPACES)))
    return F.filter(parts, lambda s: s != "")


def sections(text, max_chars: int) -> Column:
    """Runs of sentence pieces, joined by '. ', of about max_chars each."""
    parts = F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"[.!?]+"), lambda p: F.trim(p)), lambda s: s != "")
    # A run's length counts the two characters that join each further piece to it.
    units = lambda p: F.transform(p, lambda s: F.struct((F.length(s) + 2).alias("n"), F.lit(0).alias("key")))
    return let(parts, lambda p: let(greedy(units(p), max_chars + 4), lambda starts: F.transform(runs(p, starts), lambda r: F.array_join(r, ". "))))


def ocr_folded(text) -> Column:
    """Typeset quotes, dashes, ellipses and hard spaces as typed ones; a lone l at a word's end as I; white space squeezed."""
    t = F.replace(F.translate(_c(text), "‘’“”—–\u00a0", "''\"\"-- "), F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(F.replace(t, F.lit("l "), F.lit("I ")), r"\s+", " "))


def bm25_terms(text) -> Column:
    """Lower-cased words without marks, of 2 to 50 characters, in order and with repeats."""
    # White space stays, so that marks go from the whole text at once and not from word by word.
    bare = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: F.length(w).between(2, 50))


def bare_terms(words):
    """As bm25_terms, of an Arrow array of words that were cut at white space; those that are no terms become null."""
    import pyarrow as pa
    import pyarrow.compute as pc

    beyond = pc.invert(pc.string_is_ascii(words))
    lower = pc.replace_with_mask(pc.ascii_lower(words), beyond, pa.array([w.lower() for w in words.filter(beyond).to_pylist()], pa.string()))
    bare = pc.replace_substring_regex(lower, pattern=r"[^\p{L}\p{N}]+", replacement="")
    return pc.if_else(pc.and_(pc.greater_equal(pc.utf8_length(bare), 2), pc.less_equal(pc.utf8_length(bare), 50)), bare, pa.scalar(None, pa.string()))


def duration(ms) -> Column:
    m = _c(ms)
    return (
        F.when(m < 1000, F.format_string("%.0fms", m)).when(m < 60_000, F.format_string("%.1fs", m / 1000))
        .when(m < 3_600_000, F.format_string("%.1fm", m / 60_000)).otherwise(F.format_string("%.1fh", m / 3_600_000))
    )


def file_size(n) -> Column:
    b = _c(n).cast("double")
    shown = F.format_string("%.2f PB", b / float(1024**5))
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        shown = F.when(b < float(1024 ** (k + 1)), F.format_string(f"%.2f {unit}", b / float(1024**k))).otherwise(shown)
    return shown
