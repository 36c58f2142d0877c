"""HTML tables, blocks, chunks."""

from agentlake.operators import chunking as c

SIZES = c.Sizes()


def test_table_with_spans_and_header_fixes():
    html = "<table><tr><th>Receipte</th><th colspan=2>Year</th></tr><tr><td>001,234.00</td><td></td><td>a|b<br>c</td></tr></table>"
    assert c.markdown_tables(html) == ["| Receipts | Year | col_3 |\n| --- | --- | --- |\n| 001,234.00 |  | a\\|b c |"]
    two = "<table><tr><th></th><th>Year</th></tr><tr><th>x</th><th>Year</th></tr><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr>"
    assert c.markdown_tables(two) == ["| x | Year |\n| --- | --- |\n| r | 1 |\n|  | 2 |"]  # unclosed, two header rows
    assert c.markdown_tables("<table><tr><td>1</td><td>2</td></tr></table>")[0].startswith("| Category | col_2 |")
    assert c.markdown_tables("<p>x</p>") == ["```html\n<p>x</p>\n```"]
    same = c.markdown_tables("<table><tr><th>a</th><th>a</th></tr></table>")[0]
    assert same.splitlines()[0] == "| a | a_2 |"


def test_blocks_and_sections():
    text = "# Head\nintro\n| a | b |\n\n| 1 | 2 |\nnote\n```html\n<b>\n```\n## Next\n\ntail"
    found = c.blocks(text)
    assert [b[0] for b in found] == ["text", "table", "text", "html_fallback", "text"] and found[1][1] == "| a | b |\n\n| 1 | 2 |" and found[-1][2] == "Next"
    merged = c.sections(found, SIZES)
    assert [b[0] for b in merged] == ["section", "html_fallback", "text"] and merged[0][1] == "intro\n\n| a | b |\n\n| 1 | 2 |\n\nnote"
    long = [("text", "x", "h"), ("table", "|a|", "h"), ("text", "y" * 1000, "h")]
    assert [b[1] for b in c.sections(long, SIZES)] == ["x\n\n|a|", "y" * 1000]


def test_chunks():
    rows = [f"| {i} | {'v' * 90} |" for i in range(100)]
    parts = c.table_chunks("\n".join(["| k | v |", "|---|---|", *rows]), 4000)
    assert len(parts) > 2 and all(p.startswith("| k | v |\n|---|---|\n") and len(p) <= 4000 for p in parts) and sum(p.count("\n") - 1 for p in parts) == 100
    texts = c.text_chunks("\n\n".join(["a" * 900, "b" * 150, "c" * 900, "d" * 900]), SIZES)
    assert [t.split("\n\n")[0][0] for t in texts] == ["a", "d"] and c.text_chunks("\n\n".join(["a" * 1900, "b" * 150, "c" * 1900]), SIZES)[2].startswith("b" * 150)


def test_chunk_documents(spark):
    docs = spark.createDataFrame([("bulletin_1941_01.txt", "# T\nsome text\n\nmore"), ("blank.txt", "  "), ("null.txt", None)], "file_name string, text string")
    rows = c.chunk_documents(docs).collect()
    assert len(rows) == 1 and rows[0]["chunk_id"] == "bulletin_1941_01_c0000" and rows[0]["content"] == "Document: bulletin_1941_01.txt\nBulletin date: 1941-01\nSection: T\n\nsome text\n\nmore"
    assert c.index_records(c.chunk_documents(docs)).columns == ["content", "source", "bulletin_date", "page_info", "chunk_type"]


def test_render(spark):
    e = spark.createDataFrame([("f", 0, "a\r\nb"), ("f", 1, " "), ("f", 2, "<TABLE><tr><th>x</th></tr></TABLE>")], "file_name string, pos int, content string")
    assert c.render_elements(e).first()["text"] == "a\nb\n\n| x |\n| --- |\n\n"
