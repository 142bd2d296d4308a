"""Table functions over ordered documents: page-aware chunks of parsed blocks, and the grid of HTML tables.

Both are UDTFs over a table argument that Spark partitions by document and sorts by position, so a task holds the
open section and the pending paragraphs of one document and nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidemark.functions.text import TOKEN_RATIO
from tidemark.operators.chunking import MAX_TOKENS, own_path

#: Cells of a table that its chunk shows, and the characters of an anchor.
CELLS, ANCHOR = 20, 30
#: A span beyond this is that of a broken table.
MOST_SPAN = 1000


class _Tables(HTMLParser):
    """The outermost tables of a text: rows of (text, rows spanned, columns spanned, header)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.depth = 0
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        if self.depth != 1:
            return
        if tag == "tr":
            self.cell = None
            self.tables[-1].append([])
        elif tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            given = dict(attrs)
            span = lambda name: min(int(given[name]), MOST_SPAN) if (given.get(name) or "").isdigit() else 1
            # a row span of 0 reaches to the end of the table
            self.cell = ["", span("rowspan"), max(span("colspan"), 1), tag == "th"]
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        if tag in ("td", "th", "tr", "table") and self.depth <= 1:
            self.cell = None if self.depth == 1 or tag == "table" and self.depth == 0 else self.cell

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def grids(html: str | None) -> list[list[list[tuple[str, bool, bool]]]]:
    """The tables of a text as rows of (text, header, own): a cell stands at every place it spans, `own` at its first."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out = []
    for rows in parser.tables:
        grid: list[dict[int, tuple[str, bool, bool]]] = [{} for _ in rows]
        for r, cells in enumerate(rows):
            column = 0
            for text, down, across, header in cells:
                while column in grid[r]:
                    column += 1
                text = " ".join(text.split())
                for i in range(r, min(len(rows), r + (down or len(rows)))):
                    for j in range(column, column + across):
                        grid[i].setdefault(j, (text, header, (i, j) == (r, column)))
                column += across
        width = max((max(row) + 1 for row in grid if row), default=0)
        out.append([[row.get(j, ("", False, True)) for j in range(width)] for row in grid])
    return out


@udtf(returnType="doc_id string, pos int, tab int, row int, col int, text string, header boolean, own boolean")
class TableCells:
    """The cells of the tables of each row (doc_id, pos, html) of a table argument."""

    def eval(self, row: Row) -> Iterator[tuple]:
        for t, table in enumerate(grids(row["html"])):
            for r, cells in enumerate(table):
                for c, (text, header, own) in enumerate(cells):
                    yield row["doc_id"], row["pos"], t, r, c, text, header, own


@udtf(returnType="doc_id string, chunk_id string, chunk_type string, section_path string, title string, content string, anchor string, page_start int, page_end int, bbox array<double>, n_chars int")
class PageChunks:
    """Chunks of a document's blocks (doc_id, pos, block_type, text, heading_level, html, page, bbox, max_tokens) in order.

    Headings open sections; paragraphs are gathered until they reach the limit; tables and pictures stand alone.
    """

    def __init__(self):
        self.stack: list[tuple[int, str, str]] = [(0, "", "(root)")]
        self.numbers: Counter[tuple[str, str]] = Counter()
        self.pending: list[Row] = []

    def _chunk(self, row: Row, kind: str, chunk_type: str, content: str, last: Row, anchor: str | None = None, size: int | None = None) -> tuple:
        _, path, title = self.stack[-1]
        self.numbers[path, kind] += 1
        ident = f"{row['doc_id']}__{path or 'ROOT'}__{kind}__{self.numbers[path, kind]:03d}"
        anchor = "".join((content if anchor is None else anchor).split())[:ANCHOR]
        box = None if row["bbox"] is None else list(row["bbox"])
        return row["doc_id"], ident, chunk_type, path, title, content, anchor, row["page"], last["page"], box, len(content) if size is None else size

    def _flush(self) -> Iterator[tuple]:
        held, self.pending = self.pending, []
        text = "\n".join(r["text"] or "" for r in held)
        if text.strip():
            yield self._chunk(held[0], "text", "text", text, held[-1])

    def eval(self, row: Row) -> Iterator[tuple]:
        kind, text = row["block_type"], row["text"] or ""
        if kind == "paragraph":
            self.pending.append(row)
            if int(len("\n".join(r["text"] or "" for r in self.pending)) * TOKEN_RATIO) >= row["max_tokens"]:
                yield from self._flush()
            return
        if kind not in ("heading", "table", "image"):
            return
        yield from self._flush()
        if kind == "heading":
            level = row["heading_level"] or 1
            while self.stack and self.stack[-1][0] >= level:
                self.stack.pop()
            parent = self.stack[-1][1] if self.stack else ""
            path = own_path(text) or (f"{parent}.x" if parent else f"H{level}_{text.replace('*', '').strip()[:8]}")
            self.stack.append((level, path, text))
            yield self._chunk(row, "heading", "heading", text, row)
        elif kind == "table":
            cells = [c[0] for table in grids(row["html"]) for line in table for c in line if c[2]][:CELLS]
            shown = " | ".join(cells)
            yield self._chunk(row, "table", "table_summary", shown or "[table]", row, shown, len(shown))
        else:
            yield self._chunk(row, "img", "image", text or "[image]", row, text or "image", 0)

    def terminate(self) -> Iterator[tuple]:
        yield from self._flush()


def table_cells(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, tab, row, col, text, header, own): the grid of every table in (doc_id, pos, html)."""
    table = rows.select(F.col("doc_id").cast("string"), F.col("pos").cast("int"), F.col("html").cast("string"))
    return TableCells(table.asTable().partitionBy("doc_id").orderBy("pos"))


def page_chunks(blocks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Chunks with pages and boxes of parsed blocks (doc_id, pos, block_type, text, heading_level, html, page, bbox)."""
    kinds = {"doc_id": "string", "pos": "int", "block_type": "string", "text": "string", "heading_level": "int", "html": "string", "page": "int", "bbox": "array<double>"}
    table = blocks.select(*[F.col(c).cast(k) for c, k in kinds.items()], F.lit(max_tokens).alias("max_tokens"))
    return PageChunks(table.asTable().partitionBy("doc_id").orderBy("pos"))
