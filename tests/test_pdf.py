"""PDF files made by hand, and wiki pages cut by page breaks."""

import zlib

import pytest

from corpusloom.sources import formats, pdf


def made(pages, deflate=True):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages)))), ]
    for i, content in enumerate(pages):
        data = zlib.compress(content) if deflate else content
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i))
        objects.append(b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if deflate else b"", data))
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, x) for n, x in enumerate(objects, 1))
    return b"%PDF-1.4\n" + body + b"9999 0 obj << /CreationDate (D:20240203120000) >> endobj\n%%EOF"


def page(n, *lines):
    out = [b"BT /F1 12 Tf 72 800 Td (Running head) Tj 0 -30 Td"]
    for x in lines:
        out.append(b"(%s) Tj 0 -14 Td" % x if x else b"0 -20 Td")
    return b"\n".join([*out, b"0 -200 Td (%d) Tj ET" % n])


@pytest.mark.parametrize("deflate", [True, False])
def test_pages_heads_numbers_and_hyphens(deflate):
    pages = [page(1, b"The first para-", b"graph goes on", b"to its end.", b"", b"A \\(second\\) one."), page(2, b"Caf\\351 on [page] two."), b"BT ET", page(4, b"Last words.")]
    got = pdf.read(made(pages, deflate))
    assert got == {"blocks": ["The first paragraph goes on to its end.", "A (second) one.", "Café on [page] two.", "Last words."], "doc_date": "2024-02-03", "flags": ["page 3 has no text"]}


def test_arrays_hex_strings_and_next_lines():
    content = b"BT 14 TL 1 0 0 1 72 700 Tm [(He) -20 (llo) -300 (you)] TJ T* <776f726c64> Tj (second) ' ET"
    assert pdf.lines(content) == [(700.0, "Hello you"), (686.0, "world"), (672.0, "second")]


def test_what_is_no_pdf_is_flagged(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made([page(1, b"Hello there.")]))
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in formats.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.pdf"]["blocks"][-1].endswith("Hello there.") and rows["b.pdf"]["flags"] == ["unreadable: ValueError"]


def test_wiki_pages(spark):
    assert formats.joined_paragraphs(["One sen-", "tence here.", "Two", "three.", "Four"]) == ["One sentence here.", "Two three.", "Four"]
    html = "<body><p>Menu</p><p>This is a paragraph of ten words that is cut by</p><p>a page break here.</p><p>Back to top</p></body>"
    row = spark.createDataFrame([(html,), (None,)], "html string").select(formats.wiki_text("html").alias("t")).collect()
    assert [r["t"] for r in row] == ["This is a paragraph of ten words that is cut by a page break here.", ""]
