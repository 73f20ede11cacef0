"""Predicates on files, urls, texts, ids and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tokens

# Fixed values of the id and file rules.
DOCUMENT_ID, LONG_DOCUMENT_ID = r"^doc_\d+_[a-f0-9]{8}$", r"^doc_\d{10,}_[a-f0-9]{8}$"
CHUNK_ID = r"^chunk_doc_\d+_[a-f0-9]{8}_\d+$"
EXTENSIONS = ["pdf", "docx", "txt"]
MAX_FILE_BYTES = 100 * 1024 * 1024


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./\\]+)$", 1))


def valid_file(name, size) -> Column:
    """A plain name of at most 255 characters, a known type, and 1 byte to the size limit."""
    n = _c(name)
    plain = ~n.contains("..") & ~n.rlike(r'[/\\<>:"|?*]') & (F.length(n) <= 255)
    return plain & extension(n).isin(EXTENSIONS) & _c(size).between(1, MAX_FILE_BYTES)


def safe_name(name) -> Column:
    base = F.regexp_extract(_c(name), r"([^/\\]*)$", 1)
    return F.substring(F.regexp_replace(F.regexp_replace(base, r'[<>:"|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", ""), 1, 255)


def valid_url(url, domains: list[str] | None = None) -> Column:
    u = _c(url)
    host = F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))
    ok = F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("")).isin("http", "https") & (host != "")
    for i, d in enumerate(domains or []):
        ends = host.endswith(d)
        found = ends if i == 0 else found | ends  # noqa: F821
    return ok & found if domains else ok


def domain(url) -> Column:
    return F.try_parse_url(_c(url), F.lit("AUTHORITY"))


def meaningful(text, min_words: int = 3) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return (tokens.word_count(t) >= min_words) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 3)


def sufficient(text, min_chars: int = 50) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return (F.length(F.trim(t)) >= min_chars) & t.rlike(r"[.!?]")


def text_length(text, least: int = 1, most: int = 1_000_000) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return (F.length(F.trim(t)) >= least) & (F.length(t) <= most)


def valid_query(text) -> Column:
    return text_length(text, 1, 1000) & meaningful(text, 1)


def document_id(made, content) -> Column:
    """doc_{time}_{8 hex digits of the content's hash}: the same content at the same time has the same id."""
    return F.concat(F.lit("doc_"), F.date_format(_c(made), "yyyyMMddHHmmss"), F.lit("_"), F.substring(F.md5(_c(content)), 1, 8))


def chunk_id(document, index) -> Column:
    return F.concat_ws("_", F.lit("chunk"), _c(document), _c(index).cast("string"))


def valid_vector(vector, dim: int) -> Column:
    v = _c(vector)
    return F.coalesce((F.size(v) == dim) & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: ~F.isnan(x)), F.lit(False))


# Media types by extension.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "txt": "text/plain",
    "zip": "application/zip",
    "rar": "application/vnd.rar",
    "7z": "application/x-7z-compressed",
}


def media_type(path) -> Column:
    out = F.lit("application/octet-stream")
    for ext, name in MEDIA_TYPES.items():
        out = F.when(extension(path) == ext, name).otherwise(out)
    return out


def unique_name(name, made) -> Column:
    """name_{time}_{8 hex digits of a hash of both}.ext, the name being made safe."""
    safe, at = safe_name(name), F.date_format(_c(made), "yyyyMMdd_HHmmss")
    stem, ext = F.regexp_replace(safe, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(safe, r"(?<=.)(\.[^.]*)$", 1)
    return F.concat(stem, F.lit("_"), at, F.lit("_"), F.substring(F.md5(F.concat(_c(name), at)), 1, 8), ext)
