"""Comments in Word files: ranges around the right paragraphs, everything else as it was."""

import io
import zipfile
from xml.etree import ElementTree

import pytest

from tidemark.sources import annotate, docx

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<{p}:document xmlns:{p}="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="urn:mc" xmlns:w14="urn:w14" mc:Ignorable="w14"><{p}:body>'
    '<{p}:p><{p}:pPr><{p}:pStyle {p}:val="Heading 1"/></{p}:pPr><{p}:r><{p}:t>Title é</{p}:t></{p}:r></{p}:p><{p}:p/>'
    '<{p}:tbl><{p}:tr><{p}:tc><{p}:p><{p}:r><{p}:t>cell</{p}:t></{p}:r></{p}:p></{p}:tc></{p}:tr></{p}:tbl>'
    '<{p}:p w14:x="a>b"><{p}:r><{p}:t>second</{p}:t></{p}:r></{p}:p><{p}:sectPr/></{p}:body></{p}:document>'
)


def package(prefix="w", comments=None):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"></Types>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rIdComments0" Type="x" Target="y"/></Relationships>')
        z.writestr("word/document.xml", BODY.replace("{p}", prefix))
        z.writestr("word/media/a.png", b"\x89PNG")
        if comments:
            z.writestr("word/comments.xml", comments)
    return buffer.getvalue()


def read(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n) for n in z.namelist()}


def ranges(xml):
    """Comment ids and the text between their marks."""
    body = ElementTree.fromstring(xml).find(f"{W}body")
    return {s.get(f"{W}id"): "".join(t.text or "" for t in p.iter(f"{W}t")) for p in body.iter(f"{W}p") for s in p.findall(f"{W}commentRangeStart") if p.find(f"{W}commentRangeEnd") is not None}


@pytest.mark.parametrize("prefix", ["w", "x"])
def test_ranges_and_parts(prefix):
    out = read(annotate.annotated_package(package(prefix), [(0, 'A "B" & C', "first\nline <2>\x01"), (1, "", "empty paragraph"), (2, "n", "second"), (99, "n", "beyond")]))
    assert ranges(out["word/document.xml"]) == {"0": "Title é", "1": "", "2": "second", "3": "second"}
    said = ElementTree.fromstring(out["word/comments.xml"])
    assert [c.get(f"{W}author") for c in said] == ['A "B" & C', "", "n", "n"]
    assert [t.text for t in said[0].iter(f"{W}t")] == ["first", "line <2>"]
    assert b'mc:Ignorable="w14"' in out["word/document.xml"] and out["word/media/a.png"] == b"\x89PNG"
    heading = ElementTree.fromstring(out["word/document.xml"]).find(f"{W}body/{W}p")
    assert [x.tag for x in heading][:2] == [f"{W}pPr", f"{W}commentRangeStart"]
    kept = out["word/document.xml"].decode()
    for mark in ("commentRangeStart", "commentRangeEnd"):
        assert kept.count(f"<{prefix}:{mark}") == 4
    assert b'Id="rIdComments1"' in out["word/_rels/document.xml.rels"] and b"/word/comments.xml" in out["[Content_Types].xml"]


def test_comments_that_are_there_stay():
    old = f'<w:comments xmlns:w="{W[1:-1]}"><w:comment w:id="4" w:author="z"><w:p/></w:comment></w:comments>'
    out = read(annotate.annotated_package(package(comments=old), [(0, "a", "new")]))
    assert [c.get(f"{W}id") for c in ElementTree.fromstring(out["word/comments.xml"])] == ["4", "5"]
    assert ranges(out["word/document.xml"]) == {"5": "Title é"} and b"rIdComments1" not in out["word/_rels/document.xml.rels"]


def test_files_of_a_folder(spark, tmp_path):
    two = package()
    for name, content in (("one", package()), ("two", two), ("bad", b"no zip")):
        (tmp_path / f"{name}.docx").write_bytes(content)
    said = spark.createDataFrame([("one", 1, "a", "x"), ("one", None, None, None), ("bad", 0, "a", "x"), ("gone", 0, "a", "x")], "doc_id string, paragraph int, author string, text string")
    got = {r.doc_id: r for r in annotate.annotated_files(spark, str(tmp_path), said).collect()}
    assert {d: (r.n_comments, r.error is None) for d, r in got.items()} == {"one": (2, True), "two": (0, True), "bad": (0, False)}
    assert len(ranges(read(bytes(got["one"].content))["word/document.xml"])) == 2 and bytes(got["two"].content) == two


def test_pictures_of_files(spark, tmp_path):
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = f'<w:document xmlns:w="{W[1:-1]}" xmlns:a="{a}" xmlns:r="{r}"><w:body><w:p><w:r><w:t>text</w:t></w:r></w:p><w:p><a:blip r:embed="i1"/><a:blip r:embed="i2"/><w:r><w:t>under it</w:t></w:r></w:p><w:tbl/><w:p><a:blip r:embed="gone"/></w:p><w:p><a:blip r:embed="i1"/></w:p></w:body></w:document>'
    rels = '<Relationships xmlns="x"><Relationship Id="i1" Target="media/a.PNG"/><Relationship Id="i2" Target="/word/media/b.jpeg"/><Relationship Id="far" Target="http://x" TargetMode="External"/></Relationships>'
    with zipfile.ZipFile(tmp_path / "one.docx", "w") as z:
        for name, data in (("word/document.xml", body), ("word/_rels/document.xml.rels", rels), ("word/media/a.PNG", "A"), ("word/media/b.jpeg", "B")):
            z.writestr(name, data)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = sorted((x.doc_id, x.pos, x.suffix, bytes(x.content)) for x in docx.read_docx_images(spark, str(tmp_path)).collect())
    assert got == [("one", 1, ".jpeg", b"B"), ("one", 1, ".png", b"A"), ("one", 5, ".png", b"A")]
    blocks = {b.pos: b.block_type for b in docx.read_docx(spark, str(tmp_path)).where("doc_id = 'one'").collect()}
    assert [p for p, k in sorted(blocks.items()) if k == "image"] == [1, 4, 5]
