"""Document structure: HTML tables as Markdown, blocks, sections, size-bounded chunks.

These are sequential within a document and independent between documents, so each document crosses to Python once
(``mapInArrow``/pandas UDF) and no shuffle is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from html import unescape
from itertools import pairwise
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.functions import text as tx
from agentlake.functions.arrow import arrow

# Misread header words.
HEADER_FIXES = {"Receipte": "Receipts", "Expendituree": "Expenditures", "Expendltures": "Expenditures", "Unexpanded": "Unexpended"}

_TAG = re.compile(r"<!--.*?-->|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>[^>]*)>", re.S)
_SPAN = re.compile(r"\b(row|col)span\s*=\s*[\"']?(\d+)", re.I)


class _Cell(NamedTuple):
    text: str
    header: bool
    down: int
    across: int


def _outermost(html: str) -> Iterator[list[re.Match]]:
    """The tags inside each outermost table; one that isn't closed ends with the page."""
    depth, inside = 0, []
    for tag in _TAG.finditer(html):
        table, closes = (tag["name"] or "").lower() == "table", bool(tag["close"])
        if depth and not (table and closes and depth == 1):
            inside.append(tag)
        if table:
            depth = max(0, depth + (-1 if closes else 1))
            if depth == 0:
                yield inside
                inside = []
    if depth:
        yield inside


def _rows(html: str, tags: list[re.Match]) -> list[list[_Cell]]:
    """Rows of closed cells, those of inner tables among them."""
    rows: list[list[_Cell]] = []
    opened = None
    for tag in tags:
        kind = f"{tag['close'] or ''}{(tag['name'] or '').lower()}"
        if kind == "tr":
            rows.append([])
        elif kind in ("td", "th"):
            opened = tag
        elif kind in ("/td", "/th") and opened:
            text = _TAG.sub(lambda t: " " if (t["name"] or "").lower() == "br" and not t["close"] else "", html[opened.end() : tag.start()])
            spans = {k.lower(): max(1, int(v)) for k, v in _SPAN.findall(opened["attrs"])}
            rows = rows or [[]]
            rows[-1].append(_Cell(unescape(text).strip(), opened["name"].lower() == "th", spans.get("row", 1), spans.get("col", 1)))
            opened = None
    while rows and not rows[-1]:
        rows.pop()
    return rows


def _laid_out(rows: list[list[_Cell]]) -> tuple[list[list[str]], int]:
    """The rows as a grid, and how many of them are headers. ``pending``: rows that each column is still taken for."""
    grid: list[list[str]] = []
    pending: list[int] = []
    for cells in [*rows, *([] for _ in range(max((c.down for r in rows for c in r), default=1)))]:
        if len(grid) >= len(rows) and not any(pending):
            break
        line, taken, at = [""] * len(pending), [max(0, n - 1) for n in pending], 0
        for cell in cells:
            while at < len(pending) and pending[at]:
                at += 1
            short = at + cell.across - len(line)
            line, taken, pending = line + [""] * short, taken + [0] * short, pending + [0] * short
            line[at] = cell.text
            taken[at : at + cell.across] = [cell.down - 1] * cell.across
            at += cell.across
        grid.append(line)
        pending = taken
    headers = max((i + 1 for i, r in enumerate(rows) if any(c.header for c in r)), default=0)
    width = max(map(len, grid), default=0)
    return [line + [""] * (width - len(line)) for line in grid], headers


def _markdown(rows: list[list[str]], headers: int) -> str:
    width = len(rows[0])
    if headers:
        titles = []
        for column in zip(*rows[:headers], strict=True):
            full = [x for x in column if x] if headers > 1 else list(column)
            titles.append(" > ".join(full[:1] + [b for a, b in pairwise(full) if a != b]))
    else:
        titles = ["Category"] + [f"col_{c + 1}" for c in range(1, width)]
    seen: dict[str, int] = {}
    for c, title in enumerate(titles):
        for wrong, right in HEADER_FIXES.items():
            title = title.replace(wrong, right)
        title = title or ("Category" if c == 0 else f"col_{c + 1}")
        seen[title] = seen.get(title, 0) + 1
        titles[c] = f"{title}_{seen[title]}" if seen[title] > 1 else title
        seen.setdefault(titles[c], 1)
    line = lambda xs: "| " + " | ".join(xs) + " |"
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ").strip()
    return "\n".join([line(map(cell, titles)), line(["---"] * width), *(line(map(cell, r)) for r in rows[headers:])])


def markdown_tables(html: str) -> list[str]:
    """A Markdown table for each outermost HTML table (H1); the html in a code fence if there is none."""
    cells = [_rows(html, tags) for tags in _outermost(html)]
    found = [_markdown(*_laid_out(rows)) for rows in cells if any(rows)]
    return found or ["```html\n" + html.strip() + "\n```"]


@dataclass(frozen=True)
class Sizes:
    text: int = 2000
    overlap: int = 200
    table: int = 4000
    section: int = 8000
    footnote: int = 1000


def _kind(line: str) -> str:
    s = line.strip()
    if s.startswith("#"):
        return "heading"
    if s.startswith("```html"):
        return "html_fallback"
    return "table" if s.startswith("|") and s.count("|") >= 2 else "text"


def blocks(text: str) -> list[tuple[str, str, str]]:
    """(type, text, heading above) of a document's blocks (H2). One blank line between table lines stays in the table."""
    lines = text.split("\n")
    kinds = [_kind(x) for x in lines]
    for i in range(1, len(lines) - 1):
        if not lines[i].strip() and kinds[i - 1] == kinds[i + 1] == "table":
            kinds[i] = "table"
    out, heading, i = [], "", 0
    while i < len(lines):
        kind, j = kinds[i], i + 1
        if kind == "heading":
            heading = lines[i].strip().lstrip("#").strip()
        elif kind == "html_fallback":
            while j < len(lines) and not lines[j].strip().startswith("```"):
                j += 1
            j = min(j + 1, len(lines))
            out.append((kind, "\n".join(lines[i:j]), heading))
        else:
            while j < len(lines) and kinds[j] == kind:
                j += 1
            body = "\n".join(lines[i:j])
            body = body.strip() if kind == "text" else body
            if body:
                out.append((kind, body, heading))
        i = j
    return out


def sections(found: list[tuple[str, str, str]], sizes: Sizes) -> list[tuple[str, str, str]]:
    """Text and the table after it become a section, with a short text that follows, if all fit (H3)."""
    out, i = [], 0
    while i < len(found):
        part = found[i : i + 2]
        if [b[0] for b in part] == ["text", "table"]:
            after = found[i + 2 : i + 3]
            part += after if after and after[0][0] == "text" and len(after[0][1]) < sizes.footnote else []
            whole = "\n\n".join(b[1] for b in part)
            if len(whole) <= sizes.section:
                out.append(("section", whole, part[0][2] or part[1][2]))
                i += len(part)
                continue
        out.append(found[i])
        i += 1
    return out


def table_chunks(table: str, most: int) -> list[str]:
    """A table in parts of at most ``most`` characters, each with the header lines; a row too long stays whole (H4)."""
    if len(table) <= most:
        return [table]
    lines = table.split("\n")
    head = next((j + 1 for j, x in enumerate(lines) if re.match(r"^\s*\|[\s\-:|]+\|\s*$", x)), 1)
    top = "\n".join(lines[:head])
    out: list[list[str]] = []
    size = 0
    for row in lines[head:]:
        if not out or size + len(row) + 1 > most:
            out.append([])
            size = len(top) + 1
        out[-1].append(row)
        size += len(row) + 1
    return ["\n".join([top, *rows]) for rows in out] or [table]


def text_chunks(text: str, sizes: Sizes) -> list[str]:
    """Paragraphs gathered up to ``sizes.text``; a short last paragraph comes again in the next chunk (H5)."""
    out: list[list[str]] = []
    size = 0
    for p in filter(None, map(str.strip, re.split(r"\n\n+", text))):
        if not out:
            out.append([])
        elif size + len(p) + 2 > sizes.text and out[-1]:
            carried = [x for x in out[-1][-1:] if sizes.overlap > 0 and len(x) <= sizes.overlap]
            out.append(carried)
            size = sum(map(len, carried))
        out[-1].append(p)
        size += len(p) + 2
    return ["\n\n".join(c) for c in out]


def document_chunks(text: str, sizes: Sizes) -> list[tuple[str, str, str]]:
    """(type, heading, content) of a document's chunks in order."""
    out = []
    for kind, body, heading in sections(blocks(text), sizes) if text.strip() else []:
        parts = [body] if kind == "section" else table_chunks(body, sizes.table) if kind == "table" else text_chunks(body, sizes)
        out += [(kind, heading, p) for p in parts]
    return out


def _chunked(batches: Iterator[pd.DataFrame], sizes: Sizes) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(name, i, *chunk) for name, text in zip(batch["file_name"], batch["text"], strict=True) for i, chunk in enumerate(document_chunks(text or "", sizes))]
        yield pd.DataFrame(rows, columns=["file_name", "chunk_no", "chunk_type", "page_info", "body"])


def chunk_documents(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of documents (file_name, text) with ids, month, context lines and sizes (H6). Blank documents have none."""
    cut = docs.select("file_name", "text").mapInPandas(partial(_chunked, sizes=sizes), "file_name string, chunk_no int, chunk_type string, page_info string, body string")
    month = tx.file_month("file_name")
    content = tx.with_context(F.col("body"), F.col("file_name"), month, F.col("page_info"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return cut.select(
        F.format_string("%s_c%04d", stem, "chunk_no").alias("chunk_id"), "file_name", "chunk_no", month.alias("bulletin_date"), "page_info", content.alias("content"), "chunk_type",
        F.length(content).alias("char_count"),
    )


def index_records(chunks: DataFrame) -> DataFrame:
    """The five fields of index records with content, in file order (H7)."""
    kept = chunks.filter(tx.strip("content") != "").orderBy("file_name", "chunk_no")
    return kept.select("content", F.col("file_name").alias("source"), "bulletin_date", "page_info", "chunk_type")


@arrow("array<string>")
def html_tables(html: pd.Series) -> pd.Series:
    return html.map(lambda h: markdown_tables(h or ""))


def render_elements(elements: DataFrame) -> DataFrame:
    """Documents (file_name, text) from elements (file_name, pos, content) (P13): tables as Markdown, other text with
    plain line ends, a blank line after each; blank elements drop out."""
    full = elements.filter(tx.strip("content") != "")
    plain = F.regexp_replace("content", "\r\n|\r", "\n")
    tables = full.filter(F.contains(F.lower("content"), F.lit("<table"))).withColumn("piece", F.array_join(html_tables("content"), "\n\n"))
    rest = full.filter(~F.contains(F.lower("content"), F.lit("<table"))).withColumn("piece", plain)
    pieces = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    return tables.unionByName(rest).groupBy("file_name").agg(F.array_join(F.transform(pieces, lambda p: F.concat(p["piece"], F.lit("\n\n"))), "").alias("text"))
