"""Office files made by hand and read again."""

from __future__ import annotations

import io
import zipfile

from quirespark.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="a"'


def paragraph(text: str, style: str = "", depth: int | None = None, run: str = "") -> str:
    p = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{depth}"/></w:numPr>' if depth is not None else "")
    return f"<w:p><w:pPr>{p}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId1" Target="media/a.png"/></Relationships>')
        z.writestr("word/media/a.png", b"png")
    return out.getvalue()


def test_documents():
    cell = lambda *t: "<w:tc>" + "".join(paragraph(x) for x in t) + "</w:tc>"
    image = '<w:p><w:r><w:t>see </w:t><a:blip r:embed="rId1"/></w:r></w:p>'
    body = paragraph("Manual", "Title") + paragraph("Part", "Heading2", run="<w:b/>") + paragraph("one", depth=0) + paragraph("two", depth=1) + paragraph("bold ", run="<w:b/>") + f"<w:tbl><w:tr>{cell('A', 'B')}{cell('x|y')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl>" + image
    want = "# Manual\n\n## Part\n\n- one\n  - two\n**bold**\n\n\n| A<br>B | x\\|y |\n| --- | --- |\n| 1 |  |\n\nsee ![](images/a.png)\n"
    assert office.document_to_markdown(docx(body)) == want and office.document_to_markdown(docx("")) == ""


def test_sheets():
    assert office.sheet_to_markdown(b'\xef\xbb\xbfa,b\n"1|2","x\ny"\n3\n') == "| a | b |\n| --- | --- |\n| 1\\|2 | x y |\n| 3 |  |\n" and office.sheet_to_markdown(b"") == ""


def test_files_that_cannot_be_read_break_nothing(spark):
    rows = [(1, "docx", bytearray(docx(paragraph("text")))), (2, "docx", bytearray(b"no archive")), (3, "csv", bytearray(b"a\n1\n")), (4, "pptx", bytearray(b"x")), (5, "docx", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, suffix string, content binary").repartition(2)
    got = {r.doc_id: (r.md, r.status) for r in office.read_office(df).collect()}
    assert got == {1: ("text\n", "ok"), 2: (None, "BadZipFile"), 3: ("| a |\n| --- |\n| 1 |\n", "ok"), 4: (None, "unsupported"), 5: (None, "unsupported")}
    assert [(r.doc_id, r.name, bytes(r.data)) for r in office.media(df).collect()] == [(1, "a.png", b"png")]
