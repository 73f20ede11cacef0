"""Documents from files: type detection, text decoding, archives, pages, and HTML.

Files come through Spark's binaryFile reader, so that any file system it knows will do; each file's
bytes are handled where its partition is. Formats that need libraries which are not installed are
reported in the error column instead of failing the job (or fail it, mode FAILFAST).
"""

from __future__ import annotations

import io
import tarfile
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import extension
from . import pdf

# Extensions by kind.
KINDS = {
    "pdf": ["pdf"],
    "docx": ["docx", "doc"],
    "txt": ["txt", "text", "md", "log", "csv", "json", "xml"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp"],
    "archive": ["zip", "tar", "gz", "tgz", "rar", "7z"],
}
ENCODINGS = ["utf-8", "utf-16", "latin-1"]
SYSTEM_FILES = r"(^|/)(__MACOSX|\.DS_Store|Thumbs\.db|desktop\.ini|[._][^/]*)|\.(tmp|temp|bak|swp)$"
MAX_MEMBERS, MAX_BYTES = 10_000, 2048 * 1024 * 1024


def kind_of(path: Column, content: Column | None = None) -> Column:
    """By extension, else by the first bytes; null if neither tells."""
    ext = extension(path)
    out = None
    for kind, known in KINDS.items():
        out = F.when(ext.isin(known), kind) if out is None else out.when(ext.isin(known), kind)
    if content is not None:
        magic = F.hex(F.substring(content, 1, 4))
        for prefix, kind in (("25504446", "pdf"), ("504B0304", "archive"), ("1F8B", "archive"), ("89504E47", "image"), ("FFD8FF", "image"), ("52617221", "archive"), ("377ABCAF", "archive")):
            out = out.when(magic.startswith(prefix), kind)
        out = out.when(F.try_validate_utf8(content.cast("string")).isNotNull(), "txt")
    return out


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, kind, size, modified, sha256, content of each file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return raw.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), kind_of(F.col("path"), F.col("content")).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


#: One-byte encodings told apart by their pairs of bytes; of equals the first.
ONE_BYTE = ["windows-1252", "windows-1251", "koi8-r", "windows-1250"]
#: The ten most frequent letters of Russian; fixed values.
COMMON = "оеаинтсрвл"
#: Below this the fixed list of encodings is tried in order.
SURE = 0.7
#: What a Cyrillic encoding loses if nearly all letters are ASCII ones, and a Latin one if none is.
BESIDE = 0.2
_ASCII_LETTERS = np.array([bytes([i]).isalpha() for i in range(256)])


@lru_cache(None)
def _pair_weights(name: str) -> np.ndarray:
    """256 x 256: how well two neighbouring bytes go together if they are in that encoding, from 0 to 1.

    Letters of another script beside each other, signs within words and capitals behind small letters do not; capitals
    in a row less than small letters; two accented Latin letters less well than one, while Cyrillic ones come in runs."""
    kinds = []  # (script, whether small), "sign", "gap" or None
    for i in range(256):
        try:
            c = bytes([i]).decode(name)
        except UnicodeDecodeError:
            kinds.append(None)
            continue
        if c.isalpha():
            script = "cyrillic" if "CYRILLIC" in unicodedata.name(c, "") else "latin"
            kinds.append((script, c.islower(), i >= 0x80))
        else:
            kinds.append(None if unicodedata.category(c) == "Cc" and i >= 0x80 else "gap" if i < 0x80 or unicodedata.category(c)[0] in "PZ" else "sign")

    def weight(a, b) -> float:
        if a is None or b is None:
            return 0.0
        if isinstance(a, str) or isinstance(b, str):
            return 0.0 if "sign" in (a, b) and not (isinstance(a, str) and isinstance(b, str)) else 1.0
        if a[0] != b[0] or a[1] and not b[1]:
            return 0.0
        fit = 1.0 if a[1] else 0.9 if b[1] else 0.75
        return 0.6 * fit if a[0] == "latin" and a[2] and b[2] else fit

    return np.array([[weight(a, b) for b in kinds] for a in kinds])


@lru_cache(None)
def _cyrillic(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Of 256 bytes, which are common Cyrillic letters, and which are any."""
    shown = [bytes([i]).decode(name, "replace").lower() for i in range(256)]
    return np.array([c in COMMON for c in shown]), np.array(["CYRILLIC" in unicodedata.name(c, "") for c in shown])


def chance(data: bytes, name: str) -> float:
    """How likely bytes are in a one-byte encoding: the mean over pairs that hold a byte over 127, less where Cyrillic letters are rare ones; 0 without any.

    A pair counts once, however often it is there: a few words in long rows are not to decide for the whole text. Words of accented
    letters alone look Cyrillic: beside many ASCII letters they are rather Latin, without any rather not."""
    x = np.frombuffer(b" " + data + b" ", np.uint8)
    pick = (x[:-1] >= 0x80) | (x[1:] >= 0x80)
    if not pick.any():
        return 0.0
    found = np.unique(x[:-1][pick].astype("i4") * 256 + x[1:][pick])
    pairs = float(_pair_weights(name).ravel()[found].mean())
    common, letters = _cyrillic(name)
    times = np.bincount(x, minlength=256)
    n = int(times[letters].sum())  # of Cyrillic letters, about two in three are common ones
    # From C0 on all four encodings have letters; here too, repeating a letter tells little.
    high, plain = (float(np.log1p(times[at]).sum()) for at in (slice(0xC0, 256), _ASCII_LETTERS))
    share = high / max(1e-9, high + plain)
    return pairs * (0.5 + min(0.5, times[common].sum() / n)) * (1 - BESIDE * (1 - share)) if n else pairs * (1 - BESIDE * share)


def encoding_of(data: bytes) -> str:
    """By its mark, UTF-8 if it is that, UTF-16 by its zeros, else the one-byte encoding that its pairs of bytes speak for.

    If none is likely, the last of ENCODINGS. Latin text is Windows' where it uses its signs."""
    if data[:3] == b"\xef\xbb\xbf":
        return "utf-8-sig"
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    odd, even = data[1::2].count(0), data[::2].count(0)
    if len(data) >= 4 and not len(data) % 2 and max(odd, even) > 0.2 * len(data) > 8 * min(odd, even):
        return "utf-16-le" if odd > even else "utf-16-be"
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    best = max(ONE_BYTE, key=lambda name: chance(data, name))
    if best != ONE_BYTE[0] and chance(data, best) >= SURE:
        return best
    # What is left of the fixed list fits always; bytes 80 to 9F are control characters in it and quotes and dashes in Windows'.
    return "windows-1252" if any(0x80 <= x <= 0x9F for x in data) else ENCODINGS[-1]


def decode_bytes(data: bytes) -> tuple[str, str]:
    """The text and the encoding; what does not fit is replaced."""
    name = encoding_of(data)
    return data.decode(name, "replace"), name


#: First bytes -> reader of an archive's members (name, bytes), for formats beyond zip and tar; register more here.
ARCHIVES: dict[bytes, Callable[[bytes], Iterator[tuple[str, bytes]]]] = {}


def register_archive(begins: bytes, reader: Callable[[bytes], Iterator[tuple[str, bytes]]]) -> None:
    """For formats whose libraries are not at hand, such as rar and 7z."""
    ARCHIVES[begins] = reader


def members(name: str, data: bytes, most: int = MAX_MEMBERS, most_bytes: int = MAX_BYTES, readers: dict | None = None) -> Iterator[tuple[str, bytes]]:
    """An archive's files in order, without system files, up to the limits."""
    import re

    def wanted(n: str) -> bool:
        return not re.search(SYSTEM_FILES, n) and ".." not in n.split("/")

    used = count = 0
    if reader := next((r for begins, r in (ARCHIVES if readers is None else readers).items() if data.startswith(begins)), None):
        for inner, content in reader(data):
            if wanted(inner):
                used, count = used + len(content), count + 1
                if used > most_bytes or count > most:
                    raise ValueError("archive exceeds its limits")
                yield inner, content
        return
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir() or not wanted(info.filename):
                    continue
                used, count = used + info.file_size, count + 1
                if used > most_bytes or count > most:
                    raise ValueError("archive exceeds its limits")
                yield info.filename, z.read(info)
        return
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for info in t:
            if not info.isfile() or not wanted(info.name):
                continue
            used, count = used + info.size, count + 1
            if used > most_bytes or count > most:
                raise ValueError("archive exceeds its limits")
            yield info.name, t.extractfile(info).read()


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _word_tree(z: zipfile.ZipFile, name: str):
    import xml.etree.ElementTree as ET

    return ET.fromstring(z.read(name))


def _body(z: zipfile.ZipFile):
    """The element that holds a file's paragraphs: its body, or the whole document where it has none."""
    tree = _word_tree(z, "word/document.xml")
    body = tree.find(f"{_WORD}body")
    return tree if body is None else body


def _runs(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_WORD}t"))


def _paragraph(p) -> str:
    text = _runs(p)
    style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
    name = style.get(f"{_WORD}val", "") if style is not None else ""
    return f"[HEADING {name[7:] or 1}] {text}" if name.startswith("Heading") and text.strip() else text


def word_parts(data: bytes, edges: bool = False) -> list[str]:
    """Paragraphs of a word-processor file, headings marked, then its tables, cells joined by ' | ', below [TABLE n].

    edges: running heads and feet too, as [HEADER] and [FOOTER]. Its XML is plain enough for the standard library."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _body(z)
        out = [t for p in body.findall(f"{_WORD}p") if (t := _paragraph(p)).strip()]
        for n, table in enumerate(body.findall(f"{_WORD}tbl"), 1):
            rows = [" | ".join(_runs(cell).strip() for cell in row.findall(f"{_WORD}tc")) for row in table.findall(f"{_WORD}tr")]
            out.append("\n".join([f"[TABLE {n}]", *rows]))
        for mark, stem in (("HEADER", "header"), ("FOOTER", "footer")) if edges else ():
            found = [_runs(_word_tree(z, name)) for name in sorted(z.namelist()) if name.startswith(f"word/{stem}") and name.endswith(".xml")]
            out += [f"[{mark}]\n{t}" for t in found if t.strip()]
    return out


def word_properties(data: bytes) -> dict:
    """title, author, created, modified, paragraphs, sections, pages (one for fifty paragraphs)."""
    import re

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _body(z)
        paragraphs = sum(bool(_runs(p).strip()) for p in body.findall(f"{_WORD}p"))
        sections = max(1, sum(1 for _ in body.iter(f"{_WORD}sectPr")))
        core = z.read("docProps/core.xml").decode("utf-8", "replace") if "docProps/core.xml" in z.namelist() else ""
    held = {k: (m[1].strip() or None) if (m := re.search(rf"<(?:dc|dcterms|cp):{tag}[^>]*>([^<]*)<", core)) else None for k, tag in (("title", "title"), ("author", "creator"), ("created", "created"), ("modified", "modified"))}
    return held | {"paragraphs": paragraphs, "sections": sections, "pages": max(1, paragraphs // 50)}


def _pdf_properties(data: bytes) -> dict:
    return {"paragraphs": None, "sections": None} | pdf.properties(data)


def _text_properties(data: bytes) -> dict:
    text = decode_bytes(data)[0]
    return {"title": None, "author": None, "created": None, "modified": None, "paragraphs": sum(bool(p.strip()) for p in text.split("\n\n")), "sections": None, "pages": max(1, len(text) // 3000)}


#: kind -> reader of a file's properties.
PROPERTIES: dict[str, Callable[[bytes], dict]] = {"txt": _text_properties, "docx": word_properties, "pdf": _pdf_properties}
#: Bytes of made or parsed content that a task hands on at a time, about.
SLICE = 8_000_000


def in_slices(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """rows as frames of about SLICE bytes, so that what a task holds does not grow with a batch's rows or files."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if size >= SLICE:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


_PROPERTY_COLUMNS = "path string, encoding string, title string, author string, created string, modified string, paragraphs int, sections int, pages int, error string"


def properties(found: DataFrame) -> DataFrame:
    """path, encoding (of plain text), title, author, created, modified, paragraphs, sections, pages, error of files()."""
    readers, names = dict(PROPERTIES), [c.split()[0] for c in _PROPERTY_COLUMNS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, kind, data in zip(f["path"], f["kind"], f["content"], strict=True):
                try:
                    rows.append({"path": path, "encoding": encoding_of(data) if kind == "txt" else None, **readers[kind](data), "error": None})
                except Exception as e:  # noqa: BLE001  reported in the row
                    rows.append(dict.fromkeys(names) | {"path": path, "error": f"{type(e).__name__}: {e}"})
            out = pd.DataFrame(rows, columns=names, dtype=object)
            for c in ("paragraphs", "sections", "pages"):
                out[c] = out[c].astype("Int32")
            yield out

    return found.select("path", "kind", "content").mapInPandas(run, _PROPERTY_COLUMNS)


def listed(found: DataFrame) -> DataFrame:
    """path, name, size, packed, error: what archives of files() hold, in order, without unpacking it."""

    def one(data: bytes) -> Iterator[tuple[str, int, int | None]]:
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                yield from ((i.filename, i.file_size, i.compress_size) for i in z.infolist() if not i.is_dir())
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                yield from ((i.name, i.size, None) for i in t if i.isfile())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(path, *x, None) for x in one(data)]
                except Exception as e:  # noqa: BLE001  reported in the row
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "name", "size", "packed", "error"], dtype=object).astype({"size": "Int64", "packed": "Int64"})

    return found.where("kind = 'archive'").select("path", "content").mapInPandas(run, "path string, name string, size long, packed long, error string")


#: kind -> parser of (name, bytes) to (part, text); register more here.
PARSERS: dict[str, Callable[[str, bytes], Iterator[tuple[str, str]]]] = {
    "txt": lambda name, data: iter([("", decode_bytes(data)[0])]),
    "pdf": lambda name, data: ((f"[PAGE {i}]", t) for i, t in enumerate(pdf.page_texts(data), 1)),
    "docx": lambda name, data: (("", t) for t in word_parts(data)),
}


def register(kind: str, parser: Callable[[str, bytes], Iterator[tuple[str, str]]], extensions: list[str]) -> None:
    PARSERS[kind] = parser
    KINDS[kind] = [*KINDS.get(kind, []), *extensions]


def _kind_of_name(name: str) -> str | None:
    ext = name.rsplit(".", 1)[-1].lower()
    return next((k for k, known in KINDS.items() if ext in known), None)


def parsed(found: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """files() -> path, part, marker, text, error: a row per page, paragraph, or file of an archive."""
    parsers, readers = dict(PARSERS), dict(ARCHIVES)  # as they are now, for the tasks

    def one(name: str, kind: str | None, data: bytes) -> Iterator[tuple[str, str]]:
        if kind == "archive":
            for member, inner in members(name, data, readers=readers):
                if (k := _kind_of_name(member)) in parsers:
                    yield f"[FILE: {member}]", "\n".join(t for _, t in parsers[k](member, inner))
        elif kind in parsers:
            yield from parsers[kind](name, data)
        else:
            raise ValueError(f"no parser for {kind}")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            for path, name, kind, data in zip(f["path"], f["name"], f["kind"], f["content"], strict=True):
                try:
                    yield from [(path, i, marker, text, None) for i, (marker, text) in enumerate(one(name, kind, data))]
                except Exception as e:  # noqa: BLE001  reported in the row
                    if mode == "FAILFAST":
                        raise
                    yield path, 0, "", None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_slices(rows(frames), ["path", "part", "marker", "text", "error"])

    return found.select("path", "name", "kind", "content").mapInPandas(run, "path string, part int, marker string, text string, error string")


def documents(parts: DataFrame) -> DataFrame:
    """path, text: parts in order, each below its marker."""
    piece = F.when(F.col("marker") == "", F.col("text")).otherwise(F.concat_ws("\n", "marker", "text"))
    listed = parts.where("text IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", piece.alias("t")))).alias("x"))
    return listed.select("path", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("text"))


def kinds(spark: SparkSession) -> DataFrame:
    """kind, extensions, parsed: what the parsers know."""
    return spark.createDataFrame([(k, sorted(v), k in PARSERS) for k, v in sorted(KINDS.items())], "kind string, extensions array<string>, parsed boolean")


def page_counts(parts: DataFrame) -> DataFrame:
    """path, pages: how many [PAGE n] parts a file has."""
    return parts.where(F.col("marker").startswith("[PAGE ")).groupBy("path").agg(F.count(F.lit(1)).alias("pages"))


def scanned(parts: DataFrame, pages: int = 3, least: int = 100) -> DataFrame:
    """path, scanned: whether the first pages hold fewer than `least` characters each, on average."""
    return parts.where(F.col("part") < pages).groupBy("path").agg((F.avg(F.length(F.trim(F.coalesce("text", F.lit(""))))) < least).alias("scanned"))


def paragraph_counts(parts: DataFrame) -> DataFrame:
    """path, paragraphs: parts that are neither tables nor running heads."""
    return parts.where(~F.col("text").rlike(r"^\[(TABLE \d+|HEADER|FOOTER)\]")).groupBy("path").agg(F.count(F.lit(1)).alias("paragraphs"))


def section(parts: DataFrame, number: int) -> DataFrame:
    """The parts of a word file's section: sections begin at headings, the one before the first is 0."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("path").orderBy("part")
    at = F.sum(F.col("text").startswith("[HEADING").cast("int")).over(by)
    return parts.withColumn("section", at).where(F.col("section") == number)


def page_range(parts: DataFrame, first: int, last: int) -> DataFrame:
    return parts.where(F.col("part").between(first - 1, last - 1))


def heading_sections(parts: DataFrame) -> DataFrame:
    """Paragraphs put together under the heading above them; 'Introduction' before the first."""
    from pyspark.sql.window import Window

    heading = F.when(F.col("text").startswith("[HEADING"), F.regexp_replace("text", r"^\[HEADING [^\]]*\] ", ""))
    by = Window.partitionBy("path").orderBy("part")
    under = parts.withColumn("heading", F.coalesce(F.last(heading, True).over(by), F.lit("Introduction")))
    body = under.where(~F.col("text").startswith("[HEADING"))
    listed = body.groupBy("path", "heading").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x"))
    return listed.select("path", "heading", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))


def text_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lines, chars, words, mean line length, estimated pages, blank."""
    lines = F.split("text", "\n")
    return docs.select(
        "doc_id", F.size(lines).alias("lines"), F.length("text").alias("chars"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"),
        F.round(F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.size(lines), 4).alias("mean_line"),
        F.greatest(F.lit(1), F.floor(F.length("text") / 3000).cast("int")).alias("pages"), (F.trim("text") == "").alias("blank"),
    )


def line_range(docs: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last, the latter left out, counted from 0."""
    return docs.select("doc_id", F.array_join(F.slice(F.split("text", "\n"), first + 1, last - first), "\n").alias("text"))


def inputs(spark: SparkSession, texts: DataFrame | None = None, pages: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """One table of inline texts (id, text), fetched pages (id, html) and parsed files: input_type, id, text, success."""
    from ..functions.text import clean

    made = []
    if texts is not None:
        made.append(texts.select(F.lit("text").alias("input_type"), F.col("id").cast("string").alias("id"), "text", (F.trim("text") != "").alias("success")))
    if pages is not None:
        body = clean("html")
        made.append(pages.select(F.lit("url").alias("input_type"), F.col("id").cast("string").alias("id"), body.alias("text"), (body != "").alias("success")))
    if found is not None:
        made.append(documents(parsed(found)).select(F.lit("file").alias("input_type"), F.col("path").alias("id"), "text", (F.trim("text") != "").alias("success")))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def samples(number: int, body: str, lang: str) -> Iterator[tuple[str, str, bytes]]:
    """(extension, kind, bytes): a text as a word file with a table, and as plain text or an archive, in turns of its number."""
    from xml.sax.saxutils import escape

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    paragraph = lambda x, style="": f"<w:p>{style}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
    shown = [x for x in body.split("\n") if x.strip(" \t\r\n")]
    rows = "".join(f"<w:tr><w:tc>{paragraph(k)}</w:tc><w:tc>{paragraph(v)}</w:tc></w:tr>" for k, v in (("lang", lang), ("id", str(number))))
    head = paragraph("Text", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>')
    document = f"<w:document {w}><w:body>{head}{''.join(map(paragraph, shown))}<w:tbl>{rows}</w:tbl><w:sectPr/></w:body></w:document>"
    core = f"<cp:coreProperties><dc:title>Document {number}</dc:title><dc:creator>{escape(lang)}</dc:creator></cp:coreProperties>"
    yield "docx", "docx", _zipped({"word/document.xml": document, "docProps/core.xml": core})
    if number % 4 == 3:
        yield "zip", "archive", _zipped({"a.txt": body, "__MACOSX/a.txt": "", "b.md": body})
    else:
        yield "txt", "txt", body.encode(("utf-8", "utf-8-sig", "utf-16")[number % 4])


def _zipped(texts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in texts.items():
            z.writestr(name, text)
    return out.getvalue()
