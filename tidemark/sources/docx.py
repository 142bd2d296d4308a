"""Word files as blocks, one task for each file of a binaryFile scan."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.chunking import pseudo_heading_level, style_level

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_RAW = "doc_id string, pos int, kind string, style string, text string, table_rows array<array<string>>"


def _text(node: ElementTree.Element) -> str:
    parts = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda _: "\t", f"{_W}br": lambda _: "\n"}
    return "".join(parts[x.tag](x) for x in node.iter() if x.tag in parts)


def body_blocks(content: bytes) -> list[tuple[str, str, str, list[list[str]] | None]]:
    """(kind, style, text, rows) in the order of the document's body; a picture comes before its paragraph's text."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            if any(x.tag.endswith("}blip") for x in node.iter()):
                out.append(("image", "", "", None))
            if text := _text(node).strip():
                out.append(("paragraph", "" if style is None else style.get(f"{_W}val", ""), text, None))
        elif node.tag == f"{_W}tbl":
            rows = [[_text(c).strip() for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            out.append(("table", "", "\n".join("| " + " | ".join(r) + " |" for r in rows), rows))
    return out


def package_images(content: bytes) -> list[tuple[int, str, bytes]]:
    """(place of the image block, name in the package, bytes) of the pictures that the body shows, in order.

    Places are those of `body_blocks`; pictures of one paragraph share its block, and linked ones have no bytes here.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        names = set(package.namelist())
        rels = "word/_rels/document.xml.rels"
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(package.read(rels)) if r.get("TargetMode") != "External"} if rels in names else {}
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
        out, pos = [], 0
        for node in body if body is not None else ():
            if node.tag == f"{_W}p":
                blips = [x for x in node.iter() if x.tag.endswith("}blip")]
                for blip in blips:
                    target = targets.get(next((v for k, v in blip.attrib.items() if k.endswith("}embed")), None), "")
                    name = target.lstrip("/") if target.startswith("/") else f"word/{target}"
                    if target and name in names:
                        out.append((pos, name, package.read(name)))
                pos += bool(blips) + bool(_text(node).strip())
            elif node.tag == f"{_W}tbl":
                pos += 1
    return out


def read_docx_images(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos, name, suffix, content, sha256) of the pictures in the Word files at a path; a broken file has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in files[["path", "content"]].itertuples(index=False):
                try:
                    found = package_images(content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                stem = re.sub(r"\.docx$", "", name.rsplit("/", 1)[-1])
                yield pd.DataFrame([(stem, p, n, c) for p, n, c in found], columns=["doc_id", "pos", "name", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    rows = files.mapInPandas(parse, "doc_id string, pos int, name string, content binary")
    return rows.select(tx.safe_id(F.col("doc_id")).alias("doc_id"), "pos", "name", F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1)).alias("suffix"), "content", F.sha2("content", 256).alias("sha256"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the Word files at a path; a file that is none has one block of type error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for name, content in files[["path", "content"]].itertuples(index=False):
                stem = re.sub(r"\.docx$", "", name.rsplit("/", 1)[-1])
                try:
                    rows += [(stem, i, *b) for i, b in enumerate(body_blocks(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                    rows.append((stem, 0, "error", "", str(error), None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _RAW.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    raw = files.mapInPandas(parse, _RAW)
    level = F.when(F.col("kind") == "paragraph", F.coalesce(style_level(F.col("style")), pseudo_heading_level(F.col("text"))))
    return raw.select(tx.safe_id(F.col("doc_id")).alias("doc_id"), "pos", F.when(level.isNotNull(), "heading").otherwise(F.col("kind")).alias("block_type"), "text", "table_rows", level.alias("heading_level"))
