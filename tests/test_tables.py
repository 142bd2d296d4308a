"""Table functions: spans of tables, and chunks of blocks in order whatever the partitions."""

from tidemark.operators import tables
from tidemark.sources import parsed


def texts(html):
    return [[[c[0] for c in row] for row in t] for t in tables.grids(html)]


def test_spans_of_rows_and_columns():
    html = "<p>x</p><table><tr><th rowspan=2>a<th colspan='2'>b &amp; c</tr><tr><td>d</td><td> e\n f </td></tr><tr><td colspan=3>g</table>"
    assert texts(html) == [[["a", "b & c", "b & c"], ["a", "d", "e f"], ["g", "g", "g"]]]
    assert [[c[2] for c in row] for row in tables.grids(html)[0]] == [[True, True, False], [False, True, True], [True, False, False]]
    assert texts("<table><tr><td rowspan=0>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [[["a", "b"], ["a", "c"]]]
    assert texts("<table><tr><td>a</td><td rowspan=9>b</td></tr><tr></tr><tr><td>c</td></tr></table>") == [[["a", "b"], ["", "b"], ["c", "b"]]]
    assert texts(None) == [] and texts("<table></table>") == [[]] and texts("<td>loose</td>") == []


def test_cells_of_documents(spark):
    rows = [(f"d{i % 3}", i, f"<table><tr><td colspan=2>t{i}</td></tr></table>" if i % 2 else None) for i in range(12)]
    got = tables.table_cells(spark.createDataFrame(rows, "doc_id string, pos int, html string").repartition(5)).collect()
    assert sorted((r.doc_id, r.pos, r.col, r.text, r.own) for r in got) == sorted((f"d{i % 3}", i, c, f"t{i}", c == 0) for i in range(1, 12, 2) for c in (0, 1))


BLOCKS = "doc_id string, pos int, block_type string, text string, heading_level int, html string, page int, bbox array<double>"


def test_page_chunks(spark):
    rows = [
        ("d", 0, "paragraph", "before any heading", None, None, 1, [0.0, 1.0]), ("d", 1, "heading", "1 General", 1, None, 1, None), ("d", 2, "paragraph", "one", None, None, 1, [1.0]),
        ("d", 3, "paragraph", "two", None, None, 2, [2.0]), ("d", 4, "table", None, None, "<table><tr><td>a</td><td>b</td></tr></table>", 2, None), ("d", 5, "image", None, None, None, 3, None),
        ("d", 6, "heading", "1.1 Detail", 2, None, 3, None), ("d", 7, "paragraph", " ", None, None, 3, None), ("d", 8, "heading", "附录A 表", 1, None, 4, None), ("d", 9, "table", None, None, None, 4, None),
        ("d", 10, "header", "furniture", None, None, 4, None), ("d", 11, "paragraph", "end", None, None, 5, None), ("e", 0, "paragraph", None, None, None, 1, None),
    ]
    df = spark.createDataFrame(rows, BLOCKS)
    got = {r.chunk_id: r for r in tables.page_chunks(df.repartition(4)).collect()}
    assert list(sorted(got)) == sorted([
        "d__ROOT__text__001", "d__1__heading__001", "d__1__text__001", "d__1__table__001", "d__1__img__001", "d__1.1__heading__001", "d__APP_A__heading__001", "d__APP_A__table__001", "d__APP_A__text__001"])
    one = got["d__1__text__001"]
    assert (one.content, one.page_start, one.page_end, list(one.bbox), one.title, one.n_chars) == ("one\ntwo", 1, 2, [1.0], "1 General", 7)
    assert got["d__1__table__001"].content == "a | b" and got["d__APP_A__table__001"].content == "[table]" and got["d__1__img__001"].n_chars == 0
    small = tables.page_chunks(df, max_tokens=1).where("chunk_type = 'text'").count()
    assert small == 4  # each paragraph by itself
    assert tables.page_chunks(df.limit(0)).count() == 0


def test_scanned_documents(spark):
    pages = spark.createDataFrame([("a", 1, None), ("a", 2, " "), ("b", 1, "x" * 60), ("b", 2, None), ("c", 9, "late page")], "doc_id string, page_num int, text string")
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    assert {r.doc_id: r.is_scanned for r in parsed.scanned(pages, docs=docs).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert {r.doc_id: r.is_scanned for r in parsed.scanned(pages).collect()} == {"a": True, "b": False}
