"""Reading of PDF files that the tests write themselves."""

import zlib

from pyspark.sql import functions as F

from scriptoria.operators import detect, layout
from scriptoria.sources import files, pdf


def sample(pages, info=b"/Title (Pump \\(A\\)) /Author <FEFF00C9>", packed=False, extra=b""):
    """A PDF file of pages, each a list of (x, y, size, text)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 4: b"<< " + info + b" >>"}
    kids = []
    for i, spans in enumerate(pages):
        body = b"".join(b"BT /F1 %d Tf 1 0 0 1 %d %d Tm (%s) Tj ET\n" % (size, x, y, text.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)")) for x, y, size, text in spans)
        data = zlib.compress(body)
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), b" ".join(kids))
    out = b"%PDF-1.5\n"
    if packed:
        inner = {n: o for n, o in objects.items() if b"stream" not in o}
        body, head = b"", b""
        for n, o in inner.items():
            head += b"%d %d " % (n, len(body))
            body += o + b" "
        data = zlib.compress(head + body)
        objects = {n: o for n, o in objects.items() if n not in inner} | {90: b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(inner), len(head), len(data), data)}
    out += b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())
    return out + b"trailer\n<< /Root 1 0 R /Info 4 0 R " + extra + b">>\n%%EOF"


PAGES = [[(50, 700, 20, "Pump (A)"), (50, 660, 10, "Druck für 5 bar"), (300, 660, 10, "  ")], [], [(50, 700, 10, "last page")]]


def test_pages_and_metadata():
    for packed in (False, True):
        rows = list(pdf.pages(sample(PAGES, packed=packed)))
        assert [(r["page_num"], r.get("block_num"), r.get("text")) for r in rows] == [(0, 0, "Pump (A)"), (0, 1, "Druck für 5 bar"), (1, None, None), (2, 0, "last page")]
        first = rows[0]
        assert (first["width"], first["height"], first["rotation"], first["x0"], first["font_size"], first["font_name"]) == (600, 800, 0, 50, 20, "Helvetica") and 80 <= first["y0"] < 100 < first["y1"] < 110
        m = next(pdf.metadata(sample(PAGES, packed=packed)))
        assert (m["title"], m["author"], m["subject"], m["pages"], m["encrypted"]) == ("Pump (A)", "É", "", 3, False)
    locked = sample(PAGES, extra=b"/Encrypt 4 0 R ")
    assert next(pdf.metadata(locked))["encrypted"] and next(pdf.metadata(locked))["pages"] is None


def test_content_streams():
    """Kerned strings, line moves, escapes, hexadecimal strings, scaled pages, images within the stream, a Unicode map."""
    doc = pdf.Document(sample([]))
    text = lambda data: [(s[0], round(s[1]), round(s[2]), round(s[4])) for s in pdf._spans(doc, data, {"Font": {"F": pdf.Ref(3)}})]
    assert text(b"BT /F 10 Tf 5 7 Td [(Pu) 20 (mp) -300 (A)] TJ 12 TL T* (b\\\nc\\101) Tj (x) ' ET") == [("Pump A", 5, 7, 10), ("bcA", 5, -5, 10), ("x", 5, -17, 10)]
    assert text(b"q 2 0 0 2 1 1 cm BT /F 10 Tf 1 0 0 1 3 4 Tm <4142> Tj ET Q BI /W 1 ID \x00(no)\x01 EI BT (y) Tj ET") == [("AB", 7, 9, 20), ("y", 0, 0, 0)]
    cmap = b"1 beginbfchar <01> <00E9> endbfchar 1 beginbfrange <02> <04> <0061> endbfrange 1 beginbfrange <05> <06> [<0058> <0059>] endbfrange"
    assert pdf._unicode_map(cmap) == {1: "é", 2: "a", 3: "b", 4: "c", 5: "X", 6: "Y"}


def test_from_folder_to_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sample(PAGES))
    (tmp_path / "b.pdf").write_bytes(b"no pdf at all")
    (tmp_path / "empty.pdf").write_bytes(b"")
    found = files.read_folder(spark, str(tmp_path))
    spans = pdf.read_pdf(found)
    assert sorted(r.path.split("/")[-1] for r in found.select("path").collect()) == ["a.pdf", "b.pdf"]  # files of no bytes are no rows of the source
    assert spans.count() == 5 and [r.path.split("/")[-1] for r in spans.filter("error is not null").collect()] == ["b.pdf"]
    pages = layout.assemble_pages(pdf.pdf_blocks(spans), threshold=0, fix_hyphens=False)
    got = {r.page_num: r.full_text for r in pages.collect()}
    assert got == {0: "Pump (A) Druck für 5 bar", 2: "last page"}
    m = {r.path.split("/")[-1]: r for r in pdf.pdf_metadata(found).collect()}
    assert (m["a.pdf"].title, m["a.pdf"].pages, m["a.pdf"].error) == ("Pump (A)", 3, None) and m["b.pdf"].error and m["b.pdf"].pages is None
    assert spans.groupBy("path").agg(detect.has_text(F.array_join(F.collect_list("text"), " ")).alias("t")).filter("t").count() == 0  # less text than a page needs
