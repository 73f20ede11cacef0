"""PDF files made from texts, for queries that read them back: in turns of their numbers, a table of references with plain
strings; object streams, a compressed stream of references and codes with a ToUnicode map; and kerned
strings under two filters with a table of references that leads nowhere."""

from __future__ import annotations

import base64
import zlib

PER_PAGE = 40


def page_lines(text: str) -> list[list[str]]:
    lines = [x for x in text.split("\n") if x.strip()]
    return [lines[i : i + PER_PAGE] for i in range(0, max(len(lines), 1), PER_PAGE)]


def _literal(raw: bytes) -> bytes:
    for sign, to in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r")):
        raw = raw.replace(sign, to)
    return b"(" + raw + b")"


def _is_plain(text: str) -> bool:
    try:
        return text.encode("cp1252").decode("cp1252") == text
    except UnicodeError:
        return False


def _stream(body: bytes, extra: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), extra, body)


def _rows_differ(rows: list[bytes]) -> bytes:
    """Each row as its difference from the one above, under its filter's number."""
    out, above = bytearray(), bytes(len(rows[0]))
    for row in rows:
        out += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    return bytes(out)


def made(number: int, text: str, created: str) -> bytes:
    pages, kind = page_lines(text), number % 3
    plain = _is_plain(text) and kind != 1
    codes = {} if plain else {c: i for i, c in enumerate(sorted(set(text)), 3)}

    def shown(line: str) -> bytes:
        if kind == 2 and plain:  # kerned within words, no gap as wide as a space
            parts = [_literal(line[i : i + 5].encode("cp1252")) for i in range(0, len(line), 5)]
            return b"[" + b" -30 ".join(parts) + b"] TJ"
        return (_literal(line.encode("cp1252")) if plain else b"<" + b"".join(b"%04X" % codes[c] for c in line) + b">") + b" Tj"

    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Title %s /Author <FEFF%s> /CreationDate (%s) >>" % (_literal(f"Document {number}".encode()), "Tessera".encode("utf-16-be").hex().encode(), created.encode())}
    streams: dict[int, bytes] = {}
    if plain:
        objects[4] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [%s] >>" % b" ".join([b"600"] * 256)
    else:
        mapped = [b"<%04X> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for c, i in codes.items()]
        blocks = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(mapped[i : i + 100]), b"\n".join(mapped[i : i + 100])) for i in range(0, len(mapped), 100))
        streams[6] = _stream(zlib.compress(b"begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n" + blocks + b"endcmap"), b"/Filter /FlateDecode")
        objects[4] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 6 0 R >>"
        objects[5] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Own /DW 600 >>"
    at, kids = 7, []
    for lines in pages:
        body = b"BT /F1 10 Tf 12 TL 40 800 Td\n" + b"\n".join(shown(x) + b" T*" for x in lines) + b"\nET"
        kids.append(b"%d 0 R" % at)
        objects[at] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (at + 1)
        if kind == 2:
            streams[at + 1] = _stream(base64.a85encode(zlib.compress(body)) + b"~>", b"/Filter [/ASCII85Decode /FlateDecode]")
        else:
            streams[at + 1] = _stream(zlib.compress(body), b"/Filter /FlateDecode") if kind else _stream(body)
        at += 2
    objects[2] = b"<< /Type /Pages /Count %d /Resources << /Font << /F1 4 0 R >> >> /Kids [%s] >>" % (len(kids), b" ".join(kids))

    out, places = bytearray(b"%PDF-1.5\n"), {}

    def put(n: int, body: bytes) -> None:
        places[n] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (n, body))

    for n, body in streams.items():
        put(n, body)
    if kind == 1:
        held = list(objects.items())
        begins, raw = [], b""
        for n, body in held:
            begins.append(b"%d %d" % (n, len(raw)))
            raw += body + b"\n"
        head = b" ".join(begins) + b"\n"
        put(at, _stream(zlib.compress(head + raw), b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(held), len(head))))
        inner = {n: i for i, (n, _) in enumerate(held)}
        here = len(out)
        row = lambda n: (b"\x02" + at.to_bytes(4, "big") + inner[n].to_bytes(2, "big")) if n in inner else (b"\x01" + places.get(n, here).to_bytes(4, "big") + b"\0\0") if n in places or n == at + 1 else bytes(7)
        rows = _rows_differ([row(n) for n in range(at + 2)])
        put(at + 1, _stream(zlib.compress(rows), b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Info 3 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>" % (at + 2)))
        return bytes(out) + b"startxref\n%d\n%%%%EOF" % here
    for n, body in objects.items():
        put(n, body)
    here = len(out)
    table = b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(at))
    out += b"xref\n0 %d\n%strailer\n<< /Size %d /Root 1 0 R /Info 3 0 R >>\n" % (at, table, at)
    return bytes(out) + b"startxref\n%d\n%%%%EOF" % (here if kind == 0 else 5)
