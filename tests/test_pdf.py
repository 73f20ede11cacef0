import zlib

import pytest

from tessera.plans import pdf_samples
from tessera.sources import files, pdf

# Written by hand, with what the samples of the queries lack.
HELLO = rb"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 4 0 R >> /XObject << /X 8 0 R >> >> /Contents [5 0 R 7 0 R] >> endobj
4 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /fi /uni20AC /germandbls] >>
  /FirstChar 32 /Widths [278] >> endobj
5 0 obj << /Length 9 0 R >> stream
BT /F1 24 Tf 100 700 Td (Hello \(nested (brackets)\) \101\
BC) Tj 0 -30 Td (\001\002\003\004) Tj % a comment ( with a bracket
ET
endstream endobj
6 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 4 0 R >> >> >> endobj
7 0 obj << /Length 400 >> stream
q 1 0 0 1 100 600 cm BT /F1 10 Tf 0 0 Td [(Wor) 20 (ld)] TJ 100 0 Td (apart) Tj ET Q
BT /F1 10 Tf 14 TL 1 0 0 1 100 500 Tm (one) ' (two) ' 2 1 (three) " ET
BI /W 1 /H 1 ID (\x00 EI
/X Do BT (no font yet, but one is held) Tj ET
endstream endobj
8 0 obj << /Subtype /Form /Matrix [1 0 0 1 0 -50] /Length 60 >> stream
BT /F1 10 Tf 100 300 Td <496E20666F726D> Tj ET
endstream endobj
9 0 obj 9999 endobj
trailer << /Root 1 0 R /Info << /Title <FEFF00C4> /Author (  ) >> >>
"""


def test_hand_written_file_without_references():
    first, second = pdf.page_texts(HELLO)
    assert first.split("\n") == ["Hello (nested (brackets)) ABC", "éfi€ß", "World apart", "one", "two", "three", "In form", "no font yet, but one is held"] and second == ""
    assert pdf.properties(HELLO) == {"title": "Ä", "author": None, "created": None, "modified": None, "pages": 2}


@pytest.mark.parametrize("text", ["", "one", "a (b) \\ c\nå é ü\n\n x  y ", "漢字 😀\nтекст\n" + "line\n" * 90, "tab\tand \r return", "’“”–…€"])
@pytest.mark.parametrize("number", range(3))
def test_samples_are_read_back(number, text):
    data = pdf_samples.made(number, text, "D:2024")
    assert pdf.page_texts(data) == ["\n".join(x) for x in pdf_samples.page_lines(text)]
    assert pdf.properties(data)["pages"] == len(pdf_samples.page_lines(text))


def test_ranges_and_lists_of_a_map():
    font = pdf.Font.__new__(pdf.Font)
    font.map, font.lengths, font.widths, font.default = {}, [2], {}, 1000
    font._unicode(b"1 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 2 beginbfrange <20> <22> <0041> <8001> <8002> [<00660069> <D83DDE00>] endbfrange")
    assert "".join(x for x, *_ in font.read(b"\x20\x21\x22\x80\x01\x80\x02")) == "ABCfi😀"


@pytest.mark.parametrize("how", range(5))
def test_predictors(how):
    rows = [bytes([5, 7, 9, 250]), bytes([6, 6, 0, 3])]
    out, above = b"", bytes(4)
    for row in rows:
        left = bytes([0]) + row[:-1]
        corner = bytes([0]) + above[:-1]
        paeth = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, above, corner, strict=True)]
        guess = [[0] * 4, left, above, [(a + b) // 2 for a, b in zip(left, above, strict=True)], paeth][how]
        out += bytes([how]) + bytes((x - g) & 255 for x, g in zip(row, guess, strict=True))
        above = row
    assert pdf._unpredicted(out, {"Predictor": 10 + how, "Columns": 4}) == b"".join(rows)


def test_files_that_cannot_be_read_are_rows_with_an_error(spark):
    good = pdf_samples.made(1, "x\ny", "D:2024")
    locked = HELLO.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << >>")
    made = [("/a.pdf", good), ("/b.pdf", b"%PDF-1.4 nothing"), ("/c.pdf", locked), ("/d.pdf", b""), ("/e.pdf", good[: len(good) // 2])]
    found = spark.createDataFrame([(p, p[1:], "pdf", d) for p, d in made], "path string, name string, kind string, content binary")
    out = {(r["path"], r["part"]): (r["marker"], r["text"], r["error"]) for r in files.parsed(found).collect()}
    assert out["/a.pdf", 0] == ("[PAGE 1]", "x\ny", None) and "encrypted" in out["/c.pdf", 0][2]
    assert all(out[p, 0][2] for p in ("/b.pdf", "/d.pdf", "/e.pdf"))
    assert {r["path"]: r["pages"] for r in files.properties(found).where("error IS NULL").collect()} == {"/a.pdf": 1}


def test_a_stream_that_breaks_off_gives_what_is_there():
    body = zlib.compress(b"BT /F1 10 Tf (kept) Tj ET " * 500)
    file = pdf.File(HELLO)
    assert b"kept" in file._filtered({"Filter": pdf.Name("FlateDecode")}, body[: len(body) - 6])


def test_files_are_parsed_once_for_pages_and_texts(spark, sf_small):
    from tessera.plans import catalog

    plan = catalog.files_pdf(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2  # made and read for their properties
