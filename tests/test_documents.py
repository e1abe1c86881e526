"""HTML bodies, PDF and office files as sources of text."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from sparkveil.config import BUILTIN, Config
from sparkveil.functions.html import text_of
from sparkveil.functions.projection import projected
from sparkveil.operators import jobs, markup, redact, search, spans
from sparkveil.sources import mail, office, pdf
from sparkveil.sources.store import Store

HTML = [
    "<p>Hello <b>world</b></p><script>x</script>", "a &amp; b&lt;c &copy;&nbsp;x&nbsp; <i>AT&T a@b&#64;c</i>\n\n<p> line\n two &#x41;</p>&notit; x < y &unknown; &#1; z",
    "x<!-- c -->y</>z<a href='q'>k&", "&amp", "", "<style>p{}</style><p>&#128512; \U0001f600 &bogus</p>", "<br><br> \t", "a<textarea>&lt;b</textarea>&#0;&#xD800;c",
]


@pytest.mark.parametrize("html", HTML)
def test_projection_is_the_text_and_its_places(html):
    text, runs = projected(html)
    assert text == text_of(html)
    end = 0
    for a, b, c, d in runs:
        assert a < b and c < d and a >= end
        end = b
        if b - a == d - c:
            assert text[a:b] == html[c:d]
    covered = {i for a, b, *_ in runs for i in range(a, b)}
    assert all(i in covered or text[i] == " " for i in range(len(text)))


def test_spans_of_a_text_are_burned_out_of_its_markup(spark):
    html = "<div><p>SSN 572-68-<b>1439</b> or &quot;a&#64;b.org&quot;</p><p>c@d.org &amp; tail</p></div>"
    rows = markup.html_sources(spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "id long, html string"))
    found = spans.scan(rows, [BUILTIN["EMAIL_ADDRESS"]])
    placed = {r.matched_text: html[r.mark_start : r.mark_end] for r in markup.placed(found, rows).collect()}
    assert placed == {"a@b.org": "a&#64;b.org", "c@d.org": "c@d.org"}
    text = text_of(html)
    more = spark.createDataFrame([("email_body_html", 1, text.index("572"), text.index(" or")), ("email_body_html", 1, text.index("1439"), text.index("1439") + 2), ("email_body_html", 9, 0, 3)], "source_type string, source_id long, start int, end int")
    both = found.select("source_type", "source_id", "start", "end").unionByName(more)
    out = {r.source_id: r.html for r in markup.burned(rows, both).collect()}
    assert out[1] == "<div><p>SSN ███████<b>████</b> or &quot;███████&quot;</p><p>███████ &amp; tail</p></div>"
    masked = {r.source_id: r.masked for r in spans.masked(rows.select("source_type", "source_id", "text"), both).collect()}
    plain = lambda x: x.replace("SSN ███████ ████", "SSN ████████████")  # noqa: E731  a blank that joins two nodes is not in the markup
    assert {k: plain(text_of(v)) for k, v in out.items()} == masked and out[2] == "<p>none</p>"


MAIL = """From x
From: a@example.org
Subject: {n}
MIME-Version: 1.0
Content-Type: text/html

<html><body><p>write to <b>person{n}@example.org</b></p><p>or call (571) 555-012{n}</p></body></html>

"""


def test_html_bodies_are_found_proposed_and_validated(spark, tmp_path):
    """Four messages whose only body is HTML: four addresses and four numbers."""
    store = Store(spark, f"file://{tmp_path}/store")
    store.replace("cases", spark.createDataFrame([(1, "one", "processing", None, None, "2024", None)], jobs.CASE))
    (tmp_path / "m.mbox").write_text("".join(MAIL.format(n=n) for n in range(4)))
    config = Config(entity_exemptions={"EMAIL_ADDRESS": "PII", "PHONE_NUMBER": "PII"})
    assert jobs.Import(store, config, jobs.queued(store, 1, f"file://{tmp_path}/m.mbox", "box")).run()
    found = store.read("detections").where("source_type = 'email_body_html'")
    assert sorted(r.matched_text for r in found.where("entity_type = 'EMAIL_ADDRESS'").collect()) == [f"person{n}@example.org" for n in range(4)]
    assert found.where("entity_type = 'PHONE_NUMBER'").count() == 4
    assert store.read("redactions").where("source_type = 'email_body_html'").count() == 8
    emails = store.read("emails")
    sources = jobs.text_sources(emails)
    size = sources.where("source_type = 'email_body_html'").select(F.max(F.length("text"))).first()[0]
    rows = [("email_body_html", 1, 0, size, "PII", "proposed", "manual", None), ("email_body_html", 1, 0, size + 1, "PII", "proposed", "manual", None), ("email_body_html", 99, 0, 1, "PII", "proposed", "manual", None)]
    checked = redact.validated(spark.createDataFrame(rows, "source_type string, source_id long, start int, end int, exemption_code string, status string, origin string, reviewer_id string"), sources, config)
    assert [r.reason for r in checked.orderBy("source_id", "end").collect()] == [None, "beyond_text", "source_missing"]
    docs = sources.where("source_type = 'email_body_html'").select(F.lit("html").alias("scope"), F.col("source_id").alias("id"), "text")
    assert search.search(docs, ["text"], "person2").count() == 1


# --- PDF


def made_pdf(pages: list[bytes], fonts: bytes, more: list[bytes] = (), compress=True, trailer: bytes = b"", broken=False) -> bytes:
    """A file with a table of cross-references. Objects: 1 catalogue, 2 pages, 3 fonts' resources, then ``more``, then pages and contents."""
    first = 4 + len(more)
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages)))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[%s]/Count %d/Resources 3 0 R>>" % (kids, len(pages)), b"<</Font<<%s>>>>" % fonts, *more]
    for i, content in enumerate(pages):
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Contents %d 0 R>>" % (first + 2 * i + 1))
        data = zlib.compress(content) if compress else content
        objects.append(b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(data), b"/Filter/FlateDecode" if compress else b"", data))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i + 1, o)
    at = len(out) + (7 if broken else 0)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, trailer, at))


PLAIN = b"/F1<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>"
TWO = [b"BT /F1 10 Tf 72 700 Td (Hello \\(big\\) caf\\351) Tj 0 -12 Td [(SSN 5)-20(72)] TJ T* ET BT /F1 10 Tf 300 688 Td (right) Tj ET", b"BT /F1 10 Tf 1 0 0 1 72 700 Tm (second) ' (page) Tj ET"]


@pytest.mark.parametrize("how", [{}, {"compress": False}, {"broken": True}])
def test_pdf_text(how):
    assert pdf.text_layer(made_pdf(TWO, PLAIN, **how)) == ("Hello (big) café\nSSN 572 right\nsecondpage", 2)


def test_pdf_with_character_maps_and_names():
    cmap = b"/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <0020> <0021> [<4E2D> <D83DDE00>] endbfrange end"
    more = [b"<</Length %d>>\nstream\n%s\nendstream" % (len(cmap), cmap), b"<</Type/Encoding/Differences[65/eacute/germandbls/uni20AC 70/one/period]>>"]
    fonts = b"/F1<</Type/Font/Subtype/Type0/BaseFont/X/Encoding/Identity-H/ToUnicode 4 0 R>>/F2<</Type/Font/Subtype/Type1/BaseFont/Y/Encoding 5 0 R>>"
    page = b"BT /F1 10 Tf 72 700 Td <0001000200100011001200200021> Tj 0 -20 Td /F2 10 Tf (ABCFG) Tj ET"
    assert pdf.read(made_pdf([page], fonts, more)) == ["Afiabc中\U0001f600\néß€1."]


def test_pdf_with_streams_of_objects_and_references():
    """Objects inside a stream, cross-references as a stream with a predictor."""
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]/Count 1>>"), (3, b"<</Type/Page/Parent 2 0 R/Contents 5 0 R/Resources<</Font<<" + PLAIN + b">>>>>>")]
    heads, body = b"", b""
    for n, o in inner:
        heads += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = zlib.compress(heads + body)
    content = b"BT /F1 12 Tf 10 10 Td (inside) Tj ET"
    out = bytearray(b"%PDF-1.5\n")
    at4 = len(out)
    out += b"4 0 obj\n<</Type/ObjStm/N 3/First %d/Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream\nendobj\n" % (len(heads), len(packed), packed)
    at5 = len(out)
    out += b"5 0 obj\n<</Length %d>>\nstream\n%s\nendstream\nendobj\n" % (len(content), content)
    at6 = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0)]
    flat, above = b"", bytes(4)
    for a, b, c in rows:
        row = bytes([a]) + b.to_bytes(2, "big") + bytes([c])
        flat += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
        above = row
    data = zlib.compress(flat)
    out += b"6 0 obj\n<</Type/XRef/Size 7/W[1 2 1]/Root 1 0 R/Length %d/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>>>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(data), data, at6)
    assert pdf.read(bytes(out)) == ["inside"]
    assert pdf.read(bytes(out).replace(b"startxref", b"startxxxx")) == ["inside"]


def test_pdf_filters():
    import base64

    doc = pdf.Document(made_pdf(TWO, PLAIN))
    for name, data in (("ASCIIHexDecode", b"48 69>"), ("ASCII85Decode", base64.a85encode(b"Hi") + b"~>"), ("RunLengthDecode", b"\x01Hi\x80"), ("LZWDecode", bytes.fromhex("800B6050220C0C8501"))):
        got = doc.decoded(pdf.Stream({"Filter": pdf.Name(name)}, data))
        assert got == (b"Hi" if name != "LZWDecode" else b"-----A---B")


def test_extraction_of_pdfs(spark):
    sparse, full = made_pdf([b"BT /F1 9 Tf (Hi) Tj ET"], PLAIN), made_pdf(TWO, PLAIN)
    rows = [(1, "application/pdf", full), (2, "Application/PDF; x=y", sparse), (3, "application/pdf", made_pdf(TWO, PLAIN, trailer=b"/Encrypt 3 0 R")), (4, "application/pdf", b"%PDF-1.4 junk"), (5, "application/pdf", None), (6, "image/png", b"x"), (7, "application/pdf", made_pdf([b""], PLAIN))]
    frame = spark.createDataFrame(rows, "id long, content_type string, content binary")
    got = {r.id: (r.extraction_status, r.page_count, r.needs_ocr) for r in mail.extract(frame).collect()}
    assert got == {1: ("ok", 2, False), 2: ("ok", 1, True), 3: ("failed", None, True), 4: ("failed", None, True), 5: ("failed", None, True), 6: ("unsupported", None, False), 7: ("empty", 1, True)}
    done = mail.extract(frame.where("id < 4"))
    assert mail.extract(frame, done).count() == 4 and mail.extract(frame, done, force=True).count() == 7
    assert not mail.needs_ocr(2, 40) and mail.extension_of("image/webp") == ".webp" and mail.extension_of("x/y") == ".bin"


# --- office


def made_zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(*targets: tuple[str, str, str]) -> str:
    return "<Relationships xmlns='p'>" + "".join(f"<Relationship Id='{i}' Type='{R}/{t}' Target='{to}'/>" for i, t, to in targets) + "</Relationships>"


OFFICE = {
    office.DOCX: ({
        "_rels/.rels": rels(("r1", "officeDocument", "word/document.xml")), "word/_rels/document.xml.rels": rels(("n", "footnotes", "footnotes.xml")),
        "word/document.xml": "<w:document xmlns:w='w'><w:body><w:p><w:pPr/><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t><w:tab/><w:t>x</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:hyperlink><w:r><w:t>link</w:t><w:br/><w:t>end</w:t></w:r></w:hyperlink></w:p></w:body></w:document>",
        "word/footnotes.xml": "<w:footnotes xmlns:w='w'><w:footnote w:type='separator'><w:p><w:r><w:t>no</w:t></w:r></w:p></w:footnote><w:footnote><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>",
    }, "One two\tx\na\tb\nlink\nend\nnote"),
    office.XLSX: ({
        "_rels/.rels": rels(("r1", "officeDocument", "/xl/workbook.xml")), "xl/_rels/workbook.xml.rels": rels(("a", "worksheet", "worksheets/s2.xml"), ("b", "worksheet", "worksheets/s1.xml"), ("s", "sharedStrings", "sharedStrings.xml")),
        "xl/workbook.xml": f"<workbook xmlns='m' xmlns:r='{R}'><sheets><sheet name='First' sheetId='1' r:id='b'/><sheet name='Second' sheetId='2' r:id='a'/></sheets></workbook>",
        "xl/sharedStrings.xml": "<sst xmlns='m'><si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/worksheets/s1.xml": "<worksheet xmlns='m'><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>1</v></c></row><row r='2'><c r='A2'><v>42</v></c><c r='B2' t='b'><v>1</v></c></row></sheetData></worksheet>",
        "xl/worksheets/s2.xml": "<worksheet xmlns='m'><sheetData><row><c t='inlineStr'><is><t>inline</t></is></c><c t='str'><f>A1</f><v>made</v></c></row></sheetData></worksheet>",
    }, "First\nname\t\trich text\n42\tTRUE\nSecond\ninline\tmade"),
    office.PPTX: ({
        "_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml")), "ppt/_rels/presentation.xml.rels": rels(("x", "slide", "slides/slide2.xml"), ("y", "slide", "slides/slide1.xml")),
        "ppt/presentation.xml": f"<p:presentation xmlns:p='p' xmlns:r='{R}'><p:sldIdLst><p:sldId id='256' r:id='x'/><p:sldId id='257' r:id='y'/></p:sldIdLst></p:presentation>",
        "ppt/slides/slide1.xml": "<p:sld xmlns:p='p' xmlns:a='a'><p:txBody><a:p><a:r><a:t>last</a:t></a:r></a:p></p:txBody></p:sld>",
        "ppt/slides/slide2.xml": "<p:sld xmlns:p='p' xmlns:a='a'><p:txBody><a:p><a:r><a:t>title</a:t></a:r></a:p></p:txBody></p:sld>",
        "ppt/slides/_rels/slide2.xml.rels": rels(("n", "notesSlide", "../notesSlides/n1.xml")), "ppt/notesSlides/n1.xml": "<p:notes xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>spoken</a:t></a:r></a:p></p:notes>",
    }, "title\nspoken\nlast"),
    office.ODT: ({"content.xml": "<o:document-content xmlns:o='o' xmlns:t='t' xmlns:b='b'><o:body><o:text><t:tracked-changes><t:p>gone</t:p></t:tracked-changes><t:h>Head</t:h><t:p>a<t:s t:c='2'/>b<t:span> c<t:tab/></t:span>d<t:line-break/>e</t:p><b:table><b:table-row><b:table-cell><t:p>1</t:p></b:table-cell><b:table-cell b:number-columns-repeated='2'><t:p>2</t:p></b:table-cell><b:table-cell b:number-columns-repeated='9'/></b:table-row><b:table-row b:number-rows-repeated='1000'><b:table-cell/></b:table-row></b:table></o:text></o:body></o:document-content>"}, "Head\na  b c\td\ne\n1\t2\t2"),
}


def test_office_text(spark):
    rows = [(i, kind, made_zip(parts)) for i, (kind, (parts, _)) in enumerate(OFFICE.items())]
    rows += [(10, office.DOCX, b"no zip"), (11, office.DOCX, made_zip({"a": "b"})), (12, office.XLSX, made_zip({"_rels/.rels": "<broken"})), (13, "application/msword", b"old")]
    got = {r.id: r for r in mail.extract(spark.createDataFrame(rows, "id long, content_type string, content binary")).collect()}
    assert [got[i].extracted_text for i in range(4)] == [text for _, text in OFFICE.values()]
    assert [got[i].extraction_status for i in (0, 10, 11, 12, 13)] == ["ok", "failed", "failed", "failed", "unsupported"]


# --- productions as PDF


def corpus_of_three(spark):
    emails = spark.createDataFrame(
        [(1, "2024-01-02", "a@b.org", ["c@d.org"], ["e@f.org"], None, "box", 0, "Bus route", "Hello team,\n\nSSN on file: SUPER_SECRET (x). Trailing\n" + "filler line\n" * 70), (2, None, None, [], [], None, "box", 1, None, "proposed=PROPOSED rejected=REJECTED accepted=ACCEPTED"), (3, "2024-01-01", "x@y.org", [], [], "2025", "box", 2, "out", "excluded")],
        "id long, date_sent string, from_addr string, to_addrs array<string>, cc_addrs array<string>, excluded_at string, mbox_source string, mbox_index int, subject string, body_text string",
    )
    files = spark.createDataFrame([(7, 2, "f.txt", "text/plain", "attached text"), (8, 3, "g.txt", "text/plain", "of an excluded one")], "id long, email_id long, filename string, content_type string, extracted_text string")
    return emails, files


def test_a_production_is_a_pdf_whose_pages_are_the_layout(spark, tmp_path):
    from sparkveil.config import Bates
    from sparkveil.operators import produce
    from sparkveil.sources import production

    emails, files = corpus_of_three(spark)
    kept = emails.where("excluded_at IS NULL")
    sources = jobs.text_sources(kept).unionByName(files.where("id = 7").selectExpr("'attachment_text' AS source_type", "id AS source_id", "extracted_text AS text"))
    body, other = emails.where("id = 1").first().body_text, emails.where("id = 2").first().body_text
    spans_ = [("email_body_text", 1, body.index("SUPER"), body.index(" (x)"), "PII"), ("email_body_text", 2, other.index("ACCEPTED"), len(other), "FERPA"), ("email_body_text", 1, 0, 14, "A")]
    accepted = spark.createDataFrame(spans_, "source_type string, source_id long, start int, end int, exemption_code string")
    bates = Bates("ECPS", 42, 6)
    places = produce.produced(emails, files)
    printed = produce.printed_text(sources, accepted, places).unionByName(produce.printed_frame(emails, files, places))
    labels = produce.page_labels(places, bates)
    spark.dataSource.register(production.ProductionPdf)
    write = lambda n, to: production.printable(printed, labels, "Office - production", n).write.format("production_pdf").option("path", f"file://{tmp_path}/{to}").mode("append").save()
    write(5000, "one")
    n = labels.count()
    (file,) = (tmp_path / "one").glob("*.pdf")
    assert file.name == f"ECPS-000042_ECPS-{41 + n:06d}.pdf" and not [x for x in (tmp_path / "one").iterdir() if x.is_dir()]
    pages = pdf.read(file.read_bytes())
    assert len(pages) == n == 1 + places.where("source_type <> 'email_subject'").selectExpr("sum(pages)").first()[0]
    assert [f"ECPS-{42 + i:06d}" in p for i, p in enumerate(pages)] == [True] * n
    text = "\n".join(pages)
    assert all(x in text for x in ("Bus route", "(x). Trailing", "PROPOSED", "REJECTED", "PII", "FERPA", "attached text", "From:    a@b.org", "E-mail 1", "Attachment 7"))
    assert not any(x in text for x in ("SUPER", "SECRET", "ACCEPTED", "Hello", "excluded", "of an"))
    assert text.count("filler line") == 70
    where = {(r.source_type, r.source_id): r.page for r in places.collect()}
    assert "E-mail 2" in pages[where["email_subject", 2]] and "attached text" in pages[where["attachment_text", 7]]
    assert sum(p.count("filler line") for p in pages[where["email_body_text", 1] :][:1]) < 70  # it goes on over the page
    write(2, "many")
    volumes = sorted((tmp_path / "many").glob("*.pdf"))
    assert len(volumes) == -(-n // 2) and [p for v in volumes for p in pdf.read(v.read_bytes())] == pages
    with pytest.raises(Exception, match="there is a production"):
        write(2, "many")


def test_an_empty_production_is_one_page(spark, tmp_path):
    from sparkveil.config import Bates
    from sparkveil.operators import produce
    from sparkveil.sources import production

    emails, files = corpus_of_three(spark)
    places = produce.produced(emails.where("false"), files.where("false"))
    assert [r.label for r in produce.page_labels(places, Bates()).collect()] == ["PROD-000001"]
    frame = produce.printed_frame(emails, files, places)
    spark.dataSource.register(production.ProductionPdf)
    production.printable(frame, produce.page_labels(places, Bates()), "x").write.format("production_pdf").option("path", str(tmp_path / "p")).mode("append").save()
    assert len(pdf.read((tmp_path / "p/PROD-000001_PROD-000001.pdf").read_bytes())) == 1


def test_lines_break_where_the_uncovered_text_breaks(spark):
    from sparkveil.operators import produce

    sources = spark.createDataFrame([("email_body_text", 1, "ab\ncd\n" + "x" * 100)], "source_type string, source_id long, text string")
    accepted = spark.createDataFrame([("email_body_text", 1, 1, 4)], "source_type string, source_id long, start int, end int")
    got = [r.line for r in produce.production_lines(sources, accepted).orderBy("line_no").collect()]
    assert got == ["a█", "█d", "x" * 88, "x" * 12]


def test_spans_that_cover_the_same_of_a_line_are_one_box(spark):
    from sparkveil.operators import produce, spans

    sources = spark.createDataFrame([("email_body_text", 1, "x" * 200)], "source_type string, source_id long, text string")
    accepted = spark.createDataFrame([("email_body_text", 1, 0, 180, "PII"), ("email_body_text", 1, 10, 190, "PII")], "source_type string, source_id long, start int, end int, exemption_code string")
    got = {r.line_no: [tuple(b) for b in r.boxes] for r in produce.overlaid(spans.wrapped(sources, produce.WIDTH), accepted).collect()}
    assert got == {0: [(0, 88, "PII"), (10, 88, "PII")], 1: [(0, 88, "PII")], 2: [(0, 4, "PII"), (0, 14, "PII")]}


def test_html_functions_hold_a_few_pages_at_a_time():
    """Results leave before a batch is through, whatever its rows; nulls, empty and very long pages keep their places."""
    import pyarrow as pa

    from sparkveil.functions import html, projection

    pages = ["<p>a&amp;b</p>" * 60_000, None, "", "<script>x</script>", *["<b>é</b> c" * 50_000] * 30]
    taken = []

    def batches():
        for part in (pages[:3], [], pages[3:]):
            taken.append(len(part))
            yield pa.array(part, pa.string())

    got = list(html.pieces(batches(), lambda t: t and len(t)))
    assert sum(got, []) == [t and len(t) for t in pages] and len(got) > 3 and taken == [3, 0, 31]
    assert max(sum(x or 0 for x in g[:-1]) for g in got) < html._HELD
    few = pages[:4]
    structs = [x.as_py() for part in projection._projection.func(iter([pa.array(few, pa.string())])) for x in part]
    for page, x in zip(few, structs, strict=True):
        text, runs = projection.projected(page)
        assert x["text"] == text and list(zip(*(x[f] for f in projection.RUN_FIELDS), strict=True)) == runs
