"""Word files with comments: a file is a row, its comments meet it by document.

Comments are put into the package by the places of its paragraphs in the XML text, so everything else of the file stays
byte for byte as it was: ranges and references in word/document.xml, the comments in word/comments.xml (those that are
there are kept), and the relationship and content type that the part needs.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx

_MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments"
_PART = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"
_DATE = "2024-01-01T00:00:00Z"


def paragraph_places(xml: bytes) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """The prefix of the main namespace, and of each paragraph of the body (start, behind its properties, end, empty tag)."""
    found: list[list] = []
    stack: list[str] = []
    names = {"prefix": "w"}
    parser = expat.ParserCreate()

    def start(name: str, attributes: dict) -> None:
        if not stack:
            names["prefix"] = next((k[6:] for k, v in attributes.items() if k.startswith("xmlns:") and v == _MAIN), "w")
        w = names["prefix"]
        if name == f"{w}:p" and stack[-1:] == [f"{w}:body"]:
            close = xml.index(b">", parser.CurrentByteIndex) if not _quoted_end(attributes) else _tag_end(xml, parser.CurrentByteIndex)
            found.append([parser.CurrentByteIndex, close + 1, -1, xml[close - 1 : close] == b"/"])
        stack.append(name)

    def end(name: str) -> None:
        stack.pop()
        w = names["prefix"]
        if name == f"{w}:p" and stack[-1:] == [f"{w}:body"]:
            found[-1][2] = parser.CurrentByteIndex
        elif name == f"{w}:pPr" and stack[-1:] == [f"{w}:p"] and stack[-2:-1] == [f"{w}:body"]:
            found[-1][1] = max(found[-1][1], xml.index(b">", parser.CurrentByteIndex) + 1)

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(xml, True)
    return names["prefix"], [tuple(f) for f in found]


def _quoted_end(attributes: dict) -> bool:
    return any(">" in v for v in attributes.values())


def _tag_end(xml: bytes, at: int) -> int:
    """The place of the > that closes a tag, those inside quotes passed over."""
    quote = None
    for i in range(at, len(xml)):
        c = xml[i : i + 1]
        if quote is None and c == b">":
            return i
        if quote is None and c in (b'"', b"'"):
            quote = c
        elif c == quote:
            quote = None
    raise ValueError("a tag that does not end")


def annotated_package(content: bytes, comments: list[tuple[int, str, str]]) -> bytes:
    """The package with (paragraph, author, text) comments; a paragraph beyond the last counts as the last.

    A document without paragraphs, or no comments, gives the package as it was.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        parts = [(i, package.read(i)) for i in package.infolist()]
    files = {i.filename: data for i, data in parts}
    xml = files["word/document.xml"]
    w, places = paragraph_places(xml)
    if not places or not comments:
        return content
    old = files.get("word/comments.xml", b"")
    first = 1 + max([int(x) for x in re.findall(rb'\bid="(\d+)"', old)], default=-1)
    by_place: dict[int, list[int]] = {}
    entries = []
    for n, (at, author, text) in enumerate(comments, first):
        by_place.setdefault(max(0, min(at, len(places) - 1)), []).append(n)
        said = "".join(f"<w:p><w:r><w:t xml:space=\"preserve\">{escape(_legal(line))}</w:t></w:r></w:p>" for line in text.split("\n"))
        entries.append(f'<w:comment w:id="{n}" w:author="{escape(_legal(author), {chr(34): "&quot;"})}" w:date="{_DATE}">{said}</w:comment>')
    out, last = [], 0
    for at in sorted(by_place):
        start, inner, end, empty = places[at]
        opens = "".join(f'<{w}:commentRangeStart {w}:id="{n}"/>' for n in by_place[at])
        closes = "".join(f'<{w}:commentRangeEnd {w}:id="{n}"/><{w}:r><{w}:commentReference {w}:id="{n}"/></{w}:r>' for n in by_place[at])
        if empty:
            out += [xml[last : inner - 2], b">", opens.encode(), closes.encode(), f"</{w}:p>".encode()]
            last = inner
        else:
            out += [xml[last:inner], opens.encode(), xml[inner:end], closes.encode()]
            last = end
    files["word/document.xml"] = b"".join([*out, xml[last:]])
    said = "".join(entries)
    if old:
        prefix = re.search(rb"<(?:(\w+):)?comments\b", old)[1] or b""
        own = said.replace("w:", f"{prefix.decode()}:" if prefix else "") if prefix != b"w" else said
        files["word/comments.xml"] = re.sub(rb"</(?:\w+:)?comments>\s*$", lambda m: own.encode() + m[0], old)
    else:
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
        files["word/comments.xml"] = f'{head}<w:comments xmlns:w="{_MAIN}">{said}</w:comments>'.encode()
        rels = files.get("word/_rels/document.xml.rels", b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"></Relationships>')
        names = set(re.findall(rb'\bId="([^"]*)"', rels))
        ident = next(f"rIdComments{k}" for k in range(len(names) + 1) if f"rIdComments{k}".encode() not in names)
        files["word/_rels/document.xml.rels"] = rels.replace(b"</Relationships>", f'<Relationship Id="{ident}" Type="{_REL}" Target="comments.xml"/></Relationships>'.encode())
        files["[Content_Types].xml"] = files["[Content_Types].xml"].replace(b"</Types>", f'<Override PartName="/word/comments.xml" ContentType="{_PART}"/></Types>'.encode())
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as package:
        for name, data in files.items():
            package.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def _legal(text: str) -> str:
    """Text without the characters that XML cannot hold."""
    return re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", text)


def annotated_files(spark: SparkSession, path: str, comments: DataFrame) -> DataFrame:
    """(doc_id, content, n_comments, error): the Word files at a path with comments (doc_id, paragraph, author, text).

    Comments of a document are ordered by paragraph and text. A file that is no package keeps its content and has an
    error; comments without a file are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    files = files.select(tx.safe_id(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.docx$", "")).alias("doc_id"), "content")

    def write(mine: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        out = []
        said = said.sort_values(["paragraph", "text"])
        rows = [(int(p) if p == p and p is not None else 0, a or "", t or "") for p, a, t in zip(said["paragraph"], said["author"], said["text"], strict=True)]
        for doc, content in mine[["doc_id", "content"]].itertuples(index=False):
            try:
                out.append((doc, annotated_package(content, rows), len(rows), None))
            except (zipfile.BadZipFile, KeyError, expat.ExpatError, ValueError) as error:
                out.append((doc, content, 0, str(error)[:300]))
        return pd.DataFrame(out, columns=["doc_id", "content", "n_comments", "error"])

    stated = comments.select(F.col("doc_id").cast("string"), F.col("paragraph").cast("int"), "author", "text")
    return files.groupBy("doc_id").cogroup(stated.groupBy("doc_id")).applyInPandas(write, "doc_id string, content binary, n_comments int, error string")
