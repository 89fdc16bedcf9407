"""Files: sniffing, gates, Word packages, page assembly, streams."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from maskwright.functions.strings import encodable, safe_file_name, sanitized_file_name
from maskwright.plans.options import AnalyzeOptions
from maskwright.plans.pipeline import analyze, sanitize
from maskwright.sources import assembly, docx, formats, pdf
from maskwright.sources.files import process
from maskwright.streaming.stream import read_documents, sanitize_stream, write_gated


def test_sniffing(spark):
    cases = [
        (b"%PDF-1.7", None, "pdf"),
        (b'{"a":1}', None, "json"),
        (b"{not json", None, "txt"),
        (b"[1] x", None, "txt"),
        (b'{"a":NaN}', None, "txt"),
        (b'{"a":1,"a":2}', None, "json"),
        (b"PK\x03\x04zzz", None, None),
        (b"PK\x03\x04 word/document.xml", None, "docx"),
        (b"\x80\xff", None, None),
        (b"a\x00b", None, None),
        (b"a,b,c\n1,2,3\n", None, "csv"),
        (b"a,b,c\n1,2,3\n", "txt", "txt"),
        (b"prose, with a comma", None, "txt"),
        ("﻿hello".encode(), "md", "txt"),
        (b"one,two", "CSV", "csv"),
        (b"%PDF-1.7", "txt", "pdf"),
    ]
    df = spark.createDataFrame([(i, bytearray(c), e) for i, (c, e, _) in enumerate(cases)], "i int, content binary, extension string")
    rows = formats.sniffed(df).orderBy("i").collect()
    assert [r.format for r in rows] == [f for _, _, f in cases]
    assert rows[13].text == "hello" and not rows[13].mismatch and rows[15].mismatch
    assert [r.error_code for r in rows if r.format is None] == ["UNSUPPORTED_FORMAT"] * 3


def test_upload_gate(spark):
    df = spark.createDataFrame([("../../etc/passwd.txt", bytearray(b"hi")), ("a.pdf", bytearray(b"plain")), ("b", bytearray(b"")), ("c", bytearray(b"x" * 20)), (".env", bytearray(b"k=v")), ("n.bin", bytearray(b"\xff"))], "file_name string, content binary")
    rows = {r.file_name: r for r in formats.validated(df, max_bytes=10).collect()}
    assert rows["../../etc/passwd.txt"].safe_name == "passwd.txt"
    assert rows["a.pdf"].safe_name == "a.txt" and "did not match" in rows["a.pdf"].note
    assert [rows[k].error_code for k in ("b", "c", "n.bin")] == ["INVALID_INPUT", "FILE_TOO_LARGE", "UNSUPPORTED_FORMAT"]
    assert rows[".env"].safe_name == "document.txt" and rows["c"].content is None


def test_file_names(spark):
    df = spark.createDataFrame([("..\\..\\x y.docx",), ("résumé\x07.pdf",), ("a" * 500,), ("...",)], "n string")
    rows = df.select(sanitized_file_name(safe_file_name(F.col("n"), F.lit(".txt"))).alias("s")).collect()
    assert [r.s for r in rows] == ["sanitized-x_y.txt", "sanitized-re_sume__.txt", f"sanitized-{'a' * 80}.txt", "sanitized-document.txt"]


def test_generated_files(spark):
    df = spark.createDataFrame([("json", '{"a":1}', "{}"), ("json", '{"a":', "{}"), ("csv", "a,b\nc,d", "x,y\nz,w"), ("csv", "a,b,c\nc,d", "x,y\nz,w"), ("txt", "any", "x"), ("pdf", "x", "x")], "f string, t string, o string")
    rows = df.select(formats.generated(F.col("t"), F.col("o"), F.col("f")).alias("g")).collect()
    assert [r.g.error_code for r in rows] == [None, "MALFORMED_DOCUMENT", None, "MALFORMED_DOCUMENT", None, "NOT_IMPLEMENTED"]
    assert bytes(rows[4].g.bytes) == b"any"


def test_pdf_header_and_encodable(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"junk %PDF-1"),), (bytearray(b"no pdf here"),), (bytearray(b"x"),)], "c binary")
    assert [r.e for r in df.select(formats.pdf_plausible(F.col("c")).alias("e")).collect()] == [None, "SUSPICIOUS_DOCUMENT", "MALFORMED_DOCUMENT", "MALFORMED_DOCUMENT"]
    row = spark.createDataFrame([("a\r\nb\tc\x07é​☃",)], "t string").select(encodable(F.col("t"), "\\x20-\\x7E\\x{E9}").alias("e")).first()
    assert (row.e.text, row.e.substituted) == ("a\nb    cé?", 1)


def package(**parts):
    return docx.write_zip({k.replace("__", "/"): v.encode() for k, v in parts.items()})


BODY = '<w:document><w:body><w:p><w:r><w:t>Jane R</w:t></w:r><w:r><w:t xml:space="preserve">oe &amp; co</w:t></w:r></w:p><w:tbl><w:tc><w:p><w:r><w:t>cell one</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>a@b.co</w:t></w:r></w:p></w:tc></w:tbl><w:p><w:del w:author="Jane" w:initials="J"><w:r><w:delText>gone</w:delText></w:r></w:del></w:p></w:body></w:document>'


def test_docx_text_and_rewrite(spark):
    parts = {"word/document.xml": BODY.encode(), "word/header1.xml": b"<w:hdr><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>", "docProps/core.xml": b'<cp:x v="1"><dc:creator>Jane Roe</dc:creator><dc:other>no</dc:other></cp:x>', "word/embeddings/x.bin": b"secret", "word/_rels/document.xml.rels": b'<R><Relationship Id="1" Target="embeddings/x.bin"/></R>'}
    raw = docx.write_zip(parts)
    read = docx.read_docx(raw)
    assert read.text == "Jane Roe & co\x1fcell one\x1fa@b.co\ngone\n\x1f\nHead\n\x1f\nJane Roe"
    assert read.warnings == ["Embedded files were removed so they cannot carry unsanitized text."]
    df = spark.createDataFrame([(1, bytearray(raw))], "doc_id long, content binary")
    done = sanitize(analyze(docx.extracted(df), AnalyzeOptions(("EMAIL", "PERSON"))))
    out = docx.rewritten(done).first()
    again = docx.read_docx(bytes(out.bytes))
    assert out.rewrite_error is None and out.status == "pass"
    assert again.text == "[PERSON_001] & co\x1fcell one\x1f[EMAIL_001]\ngone\n\x1f\nHead\n\x1f\n[PERSON_001]" == out.sanitized
    assert "word/embeddings/x.bin" not in again.parts and b"embeddings" not in again.parts["word/_rels/document.xml.rels"]
    assert b'w:author=""' in again.parts["word/document.xml"] and b"Jane" not in again.parts["word/document.xml"]


def test_containers_are_guarded(spark):
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"\0" * 5_000_000)
    cases = [bomb.getvalue(), package(**{"..__x": "y"}), b"PK\x03\x04 no directory", package(word__other="x"), package(word__document=BODY)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, content binary")
    zips = docx.inspected(df).orderBy("i").collect()
    assert [r.safe for r in zips] == [False, False, False, True, True]
    errors = [r.extract_error for r in docx.extracted(df).orderBy("i").collect()]
    assert errors[:3] == ["SUSPICIOUS_DOCUMENT"] * 3 and errors[3] == "MALFORMED_DOCUMENT"


@pytest.mark.parametrize(("raw", "text"), [("&lt;&amp;&#65;&#x42;&apos;&quot;&gt;", "<&AB'\">"), ("&nbsp;&#xD800;&#1114112;", "&nbsp;��")])
def test_xml_references(raw, text):
    assert docx.decode_xml(raw) == text


def pieces(spark, rows):
    return spark.createDataFrame([(1, i, r[0], *map(float, r[1:])) for i, r in enumerate(rows)], "page long, seq int, str string, x double, y double, height double, width double")


def page_text(spark, rows):
    return assembly.pages(pieces(spark, rows), "page").first().text


def test_page_assembly(spark):
    assert page_text(spark, [("The value", 10, 700, 10, 50), ("wraps on", 10, 688, 10, 40)]) == "The value wraps on"
    assert page_text(spark, [("hy-", 10, 700, 10, 20), ("phen", 10, 688, 10, 20)]) == "hy-phen"
    assert page_text(spark, [("Title", 10, 700, 18, 50), ("Body", 10, 688, 10, 40)]) == "Title\n\nBody"
    assert page_text(spark, [("Name", 10, 700, 10, 30), ("Phone", 100, 700, 10, 30)]) == "Name\x1fPhone"
    assert page_text(spark, [("a", 10, 700, 10, 5), (" ", 15, 700, 10, 3), ("b", 18, 701.5, 10, 5), (" ", 23, 700, 10, 20), ("c", 43, 700, 10, 5)]) == "a b\x1fc"
    assert page_text(spark, [("one", 10, 700, 10, 5), ("far", 10, 600, 10, 5), ("up", 10, 650, 10, 5)]) == "one\n\nfar\n\nup"


def test_blocks(spark):
    df = spark.createDataFrame([([("p1", "body", "ab"), ("p2", "header", ""), ("p3", "body", "c")],)], "b array<struct<locator:string,region:string,text:string>>")
    row = df.select(assembly.flattened(F.col("b")).alias("f")).first().f
    assert row.text == "ab\f\fc" and [(s.start, s.end) for s in row.segments] == [(0, 2), (3, 3), (4, 5)]
    back = spark.createDataFrame([("x\fy", 2), ("x", 2)], "t string, n int").select(assembly.split_blocks(F.col("t"), F.col("n")).alias("s")).collect()
    assert [r.s for r in back] == [["x", "y"], None]


def test_offsets_after_rewriting(spark):
    df = spark.createDataFrame([(o, [(2, 5, "[A_001]")]) for o in (0, 2, 3, 5, 8)], "o int, d array<struct<start:int,end:int,placeholder:string>>")
    assert [r.n for r in df.select(assembly.sanitized_offset(F.col("o"), F.col("d")).alias("n")).collect()] == [0, 2, 2, 9, 12]


def test_streams(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "mail a@b.co"), (2, None)], schema).write.parquet(str(tmp_path / "in"))
    done = sanitize_stream(read_documents(spark, str(tmp_path / "in"), schema), AnalyzeOptions(("EMAIL",)))
    query = write_gated(done, str(tmp_path / "out"), str(tmp_path / "held"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [(r.doc_id, r.sanitized) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "mail [EMAIL_001]")]
    assert [(r.doc_id, r.error_code) for r in spark.read.parquet(str(tmp_path / "held")).collect()] == [(2, "MALFORMED_DOCUMENT")]


def test_files_end_to_end(spark):
    word = package(**{"word__document.xml": "<w:document><w:p><w:t>Mail a@b</w:t><w:t>.co now</w:t></w:p></w:document>"})
    media_only = docx.write_zip({"word/document.xml": b"<w:document/>", "word/media/i.png": b"x"})
    cases = [("a.txt", b"mail a@b.co"), ("b.json", b'{"m":"a@b.co"}'), ("c.docx", word), ("d.docx", media_only), ("e.pdf", b"%PDF-1"), ("f.pdf", b"junk%PDF-1"), ("p.pdf", HAND), ("q.pdf", pdf.write_pdf("Call a@b.co\n\nor A@B.co, a\x1fb\x0cCard 4111 1111\n1111 1111")[0]), ("g.csv", b"a,b\na@b.co,2"), ("h.zip", b"PK\x03\x04"), ("i.txt", b"")]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in cases], "file_name string, content binary")
    rows = {r.file_name: r for r in process(df, AnalyzeOptions(("EMAIL", "CREDIT_CARD"))).collect()}
    assert bytes(rows["a.txt"].bytes) == b"mail [EMAIL_001]" and rows["a.txt"].sanitized_name == "sanitized-a.txt"
    assert bytes(rows["b.json"].bytes) == b'{"m":"[EMAIL_001]"}' and bytes(rows["g.csv"].bytes) == b"a,b\n[EMAIL_001],2"
    assert docx.read_docx(bytes(rows["c.docx"].bytes)).text == "Mail [EMAIL_001] now" and rows["c.docx"].replaced_occurrences == 1
    held = rows["d.docx"]
    assert (held.status, held.error_code, held.bytes) == ("inconclusive", "VERIFICATION_FAILED", None)
    assert [c.id for c in held.checks if c.status != "pass"] == ["unreadable-content"]
    assert [rows[n].error_code for n in ("e.pdf", "f.pdf", "h.zip", "i.txt")] == ["MALFORMED_DOCUMENT", None, "UNSUPPORTED_FORMAT", "INVALID_INPUT"] and rows["f.pdf"].format == "txt"
    assert rows["p.pdf"].status == "inconclusive" and rows["p.pdf"].bytes is None and len(rows["p.pdf"].extract_warnings) == 3
    done = rows["q.pdf"]
    assert (done.status, done.error_code, done.replaced_groups, done.replaced_occurrences) == ("pass", None, 2, 3)
    assert [c.id for c in done.checks] == ["residual-values", "placeholders-present", "deep-streams", "structural-channels"]
    assert pdf.read_pdf(bytes(done.bytes))["text"] == "Call [EMAIL_001]\n\nor [EMAIL_001], a\x1fb\x0cCard [CREDIT_CARD_001]"


HAND = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R /Outlines 9 0 R /AcroForm << /Fields [] >> >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 /Resources << /Font << /F1 5 0 R >> >> >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [7 0 R] >> endobj
4 0 obj << /Length 95 >> stream
BT /F1 10 Tf 50 700 Td (Hello \\(x\\)) Tj 0 -12 Td [(wor) -20 (ld)] TJ 100 0 Td <666172> Tj ET
endstream endobj
5 0 obj << /Type /Font >> endobj
6 0 obj << /Type /Page /Parent 2 0 R /Contents 8 0 R /Resources << /XObject << /I 10 0 R >> >> >> endobj
7 0 obj << /Contents (note a@b.co) >> endobj
8 0 obj << /Length 5 >> stream
/I Do
endstream endobj
9 0 obj << /Count 1 >> endobj
10 0 obj << /Subtype /Image /Length 1 >> stream
x
endstream endobj
"""


def test_pdf_text_and_channels():
    found = pdf.read_pdf(HAND)
    assert found["text"] == "Hello (x) world\x1ffar\x0cnote a@b.co\x0c" and found["unreadable"] == ["page:2"]
    assert found["locators"] == ["page:1", "page:1:Contents", "page:2"]
    said, left = pdf.sweep(HAND)
    assert left == ["annotations", "forms", "bookmarks"] and "note a@b.co" in said and "Hello (x)" in said


def test_pdf_written_and_read():
    text = "Title\n\n" + "many words " * 60 + "[EMAIL_001]\n\nleft\x1fright\x0c(paren) \\ \u00e9\x0c\x0cend"
    raw, lost = pdf.write_pdf(text)
    assert pdf.write_pdf(text)[0] == raw and lost == 0 and pdf.write_pdf("\u2603\u2603")[1] == 2
    assert pdf.read_pdf(raw)["text"] == text and pdf.sweep(raw)[1] == []


def test_pdf_object_streams_and_maps():
    inner = b"11 0 12 2 5 << /T (in stream) >>"
    packed = zlib.compress(inner)
    raw = b"%PDF-1.5\n" + b"1 0 obj << /Type /ObjStm /N 2 /First 10 /Filter /FlateDecode /Length %d >> stream\n" % len(packed) + packed + b"\nendstream endobj"
    document = pdf.Document(raw)
    assert document.objects[11] == 5 and document.objects[12] == {"T": b"in stream"}
    codes, width = pdf.to_unicode(b"1 beginbfchar <0041> <00480069> endbfchar 1 beginbfrange <0050> <0052> <0061> endbfrange")
    assert width == 2 and codes == {0x41: "Hi", 0x50: "a", 0x51: "b", 0x52: "c"}


@pytest.mark.parametrize(("raw", "code"), [(b"junk%PDF-1.4", "SUSPICIOUS_DOCUMENT"), (b"nothing", "MALFORMED_DOCUMENT"), (b"%PDF-1.4 /Encrypt 1 0 R", "MALFORMED_DOCUMENT"), (b"%PDF-1.4 1 0 obj << endobj", "MALFORMED_DOCUMENT"), (b"%PDF-1.4 1 0 obj " + b"[" * 5000, "MALFORMED_DOCUMENT")])
def test_bad_pdf_files(raw, code):
    with pytest.raises(docx.BadDocument) as e:
        pdf.read_pdf(raw)
    assert e.value.code == code


def lzw(data):
    """Codes of 9 to 12 bits, as PDF wants them."""
    table, codes, held = {bytes([i]): i for i in range(256)}, [256], b""
    size, bits, n = 9, [], 258
    out = [(256, 9)]
    for i in range(len(data)):
        if held + data[i : i + 1] in table:
            held += data[i : i + 1]
            continue
        out.append((table[held], size))
        table[held + data[i : i + 1]] = n
        n += 1
        size = min(12, (n + 0).bit_length() if n + 1 > 1 << size else size)
        size = max(size, (n).bit_length())
        held = data[i : i + 1]
    out += [(table[held], size), (257, max(size, (n + 1).bit_length()))]
    whole = "".join(f"{c:0{s}b}" for c, s in out)
    whole += "0" * (-len(whole) % 8)
    return int(whole, 2).to_bytes(len(whole) // 8, "big")


def one_page(stream, entries):
    head = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F 5 0 R>>>>>>endobj\n5 0 obj<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>endobj\n"
    return head + b"4 0 obj<<" + entries + b"/Length %d>>stream\n" % len(stream) + stream + b"\nendstream endobj\ntrailer<</Root 1 0 R>>\nstartxref\n0\n%%EOF"


def test_filters_of_pdf_streams():
    import base64
    import zlib

    page = b"BT /F 12 Tf 72 700 Td (Mail jo@example.com now) Tj ET"
    rows = b"".join(b"\x01" + bytes([r[0], *((b - a) & 255 for a, b in zip(r, r[1:], strict=False))]) for r in (page[i : i + 10] for i in range(0, len(page), 10)))
    good = [
        (page, b""),
        (zlib.compress(page), b"/Filter/FlateDecode"),
        (page.hex().encode() + b">", b"/Filter/ASCIIHexDecode"),
        (base64.a85encode(zlib.compress(page)) + b"~>", b"/Filter[/ASCII85Decode/FlateDecode]"),
        (lzw(page), b"/Filter/LZWDecode"),
        (zlib.compress(rows), b"/Filter/FlateDecode/DecodeParms<</Predictor 15/Columns 10>>"),
    ]
    for stream, entries in good:
        found = pdf.read_pdf(one_page(stream, entries))
        assert "jo@example.com" in found["text"] and not found["unreadable"], entries
    for stream, entries in [(page, b"/Filter/JBIG2Decode"), (b"broken", b"/Filter/FlateDecode")]:
        assert pdf.read_pdf(one_page(stream, entries))["unreadable"] == ["page:1"], entries
    long = bytes(range(256)) * 40 + b"abc" * 900
    assert pdf.unpacked(lzw(long), 1 << 20, 1) == long
