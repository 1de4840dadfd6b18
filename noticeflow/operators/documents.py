"""Attached documents: routing, archives, document XML, and text with tables.

Only opening archives and walking XML is done in Python, one document at a time. Blocks come
back as nested columns, and Markdown is put together from them inside the JVM.
"""

from __future__ import annotations

import heapq
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.names import file_extension
from ..functions.nested import explode_rows
from ..functions.text import BULLET, count_bullets, let, markdown_table, markup_text

# What archives may hold, how deep and how large they may be.
ARCHIVED = (".hwp", ".hwpx", ".pdf", ".zip")
MAX_DEPTH = 2
MAX_ENTRIES = 5000
MAX_BYTES = 64 * 1024 * 1024
#: Documents whose results go back to Spark together, by their own size.
BATCH_BYTES = 4 * 1024 * 1024
#: Bytes of an archived file that are held while the archive is tested.
PIECE_BYTES = 1024 * 1024
# How a file is treated, by extension; other files are skipped. The older binary document format needs an external
# converter first.
ROUTES = {".hwpx": "convert", ".pdf": "pass", ".zip": "expand"}
# Document sections, and reasons given for documents without text.
SECTION = re.compile(r"^Contents/section(\d+)\.xml$", re.IGNORECASE)
UNSUPPORTED = "지원하지 않는 확장자 "
NO_EXTENSION = "없음"
EMPTY_ARCHIVE = "ZIP 안에 지원 문서가 없음"

#: A table row stands ``times`` times, and each of its cells over ``columns`` columns: spans are held once, not copied.
GRID = "array<struct<times:int,cells:array<struct<columns:int,text:string>>>>"
BLOCK = f"struct<section:string,kind:string,text:string,rows:{GRID}>"
STATS = "struct<sections:int,tables:int,rows:int,cells:int,bullets:int>"
MANIFEST = (
    "notice string, sequence string, source string, original_name string, kind string, "
    f"reason string, bytes long, blocks array<{BLOCK}>, stats {STATS}"
)
_TEXT = pa.string()
_ARROW_CELL = pa.struct([("columns", pa.int32()), ("text", _TEXT)])
_ARROW_GRID = pa.list_(pa.struct([("times", pa.int32()), ("cells", pa.list_(_ARROW_CELL))]))
_ARROW_BLOCK = pa.struct([("section", _TEXT), ("kind", _TEXT), ("text", _TEXT), ("rows", _ARROW_GRID)])
_STAT_NAMES = ("sections", "tables", "rows", "cells", "bullets")
_ARROW_MANIFEST = pa.schema(
    [
        ("notice", _TEXT),
        ("sequence", _TEXT),
        ("source", _TEXT),
        ("original_name", _TEXT),
        ("kind", _TEXT),
        ("reason", _TEXT),
        ("bytes", pa.int64()),
        ("blocks", pa.list_(_ARROW_BLOCK)),
        ("stats", pa.struct([(n, pa.int32()) for n in _STAT_NAMES])),
    ]
)


def route(name: Column | str) -> Column:
    """How a file is treated, by extension: convert, pass, expand or skip."""
    extension = file_extension(name)
    routed = F.lit("skip")
    for known, action in ROUTES.items():
        routed = F.when(extension == known, F.lit(action)).otherwise(routed)
    return routed


# ---- archives


class DocumentError(ValueError):
    pass


def safe_path(name: str) -> bool:
    return bool(name) and "\\" not in name and not name.startswith("/") and ".." not in name.split("/")


def _safe_entries(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Files with a safe path, within the limits."""
    infos = archive.infolist()
    if len(infos) > MAX_ENTRIES:
        raise DocumentError(f"archive holds {len(infos)} entries")
    safe = [i for i in infos if safe_path(i.filename)]
    if sum(i.file_size for i in safe) > MAX_BYTES:
        raise DocumentError("archive is too large when unpacked")
    return [i for i in safe if not i.is_dir()]


def archive_entries(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of an archive, one at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in _safe_entries(archive):
            yield info.filename, archive.read(info)


def _extension(name: str) -> str:
    return posixpath.splitext(posixpath.basename(name))[1].lower()


def _documents_in(content: bytes) -> list[str]:
    """Names of the documents of an archive, all of which can be read; reading them here keeps one piece at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        wanted = [i for i in _safe_entries(archive) if _extension(i.filename) in ARCHIVED]
        for info in wanted:
            with archive.open(info) as entry:
                while entry.read(PIECE_BYTES):
                    pass
        return [i.filename for i in wanted]


def expand(name: str, content: bytes, sequence: str, depth: int = 0) -> Iterator[tuple]:
    """(sequence, name, content, reason) of the documents in a file, one at a time; archives are opened.

    An archive that cannot be read whole is one error row, and nothing of it comes out.
    """
    if _extension(name) != ".zip" or depth >= MAX_DEPTH:
        yield sequence, name, content, None
        return
    try:
        found = bool(_documents_in(content))
    except Exception as error:
        yield sequence, name, content, f"error: {error or type(error).__name__}"
        return
    if not found:
        yield sequence, name, content, EMPTY_ARCHIVE
        return
    child = 0
    for entry, data in archive_entries(content):
        if _extension(entry) in ARCHIVED:
            child += 1
            yield from expand(entry, data, f"{sequence}{child}", depth + 1)


# ---- document XML

_RUNS = re.compile(r"[\t\r\n ]+")
_BULLET_RUN = re.compile(" *([◦•]) *")


def _parse_xml(text: str | bytes) -> ET.Element:
    """Element tree with local names: the prefix of document tags does not matter."""
    root = ET.fromstring(text)
    for element in root.iter():
        element.tag = element.tag.rpartition("}")[2]
    return root


def _top(element: ET.Element, *tags: str) -> Iterator[ET.Element]:
    """Outermost descendants with one of the tags, in order."""
    for child in element:
        if child.tag in tags:
            yield child
        elif len(child):
            yield from _top(child, *tags)


def _pieces(element: ET.Element) -> Iterator[str]:
    """Text of an element without the tables in it."""
    yield element.text or ""
    for child in element:
        if child.tag != "tbl":
            yield from _pieces(child)
        yield child.tail or ""


def _text(element: ET.Element, tables: list[ET.Element]) -> str:
    """Same rules as ``markup_text``, on parsed XML; ``tables`` are those in the element."""
    joined = _RUNS.sub(" ", " ".join(_pieces(element) if tables else element.itertext()))
    if "◦" in joined or "•" in joined:
        joined = _BULLET_RUN.sub(r" \1 ", joined)
    return joined.strip()


def _span(cell: ET.Element, name: str) -> int:
    for key, value in cell.attrib.items():
        if key.lower() == name and value.isdigit():
            return max(1, int(value))
    return 1


@dataclass
class _Span:
    """A cell: the columns ``start`` to ``end`` of the rows before ``until``; a later one covers an earlier one."""

    start: int
    end: int
    until: int
    text: str


def grid_rows(rows: Iterable[list[tuple[int, int, str]]]) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(times, cells) of the grid that rows of (column span, row span, text) describe; a cell is (columns, text).

    A cell starts at the first free column, and its text stands in all columns and rows of its span. What goes from row to
    row is the list of spans that are still open, so neither width nor height of a span takes memory. Rows that only open
    spans fill are one row, as often as they stand. Rows may be of unlike width.
    """
    open_: list[_Span] = []
    y = 0
    for row in rows:
        taken = sorted((s.start, s.end) for s in open_)
        at, x = 0, 0
        for columns, lines, text in row:
            while at < len(taken) and taken[at][0] <= x:
                x = max(x, taken[at][1])
                at += 1
            open_.append(_Span(x, x + columns, y + lines, text))
            x += columns
        yield 1, _painted(open_)
        y += 1
        open_ = [s for s in open_ if s.until > y]
    while open_:
        until = min(s.until for s in open_)
        yield until - y, _painted(open_)
        y = until
        open_ = [s for s in open_ if s.until > y]


def _painted(spans: list[_Span]) -> list[tuple[int, str]]:
    """One row's cells from left to right: the last span over a column shows, and free columns are empty."""
    starts = sorted(range(len(spans)), key=lambda i: spans[i].start)
    edges = sorted({x for s in spans for x in (s.start, s.end)})
    cells: list[tuple[int, str]] = []
    over: list[int] = []  # spans at this column, the last one first
    shown, x, next_ = None, 0, 0
    for left, right in zip([0, *edges], [*edges, edges[-1] if edges else 0], strict=True):
        while next_ < len(starts) and spans[starts[next_]].start <= left:
            heapq.heappush(over, -starts[next_])
            next_ += 1
        while over and spans[-over[0]].end <= left:
            heapq.heappop(over)
        if right <= left:
            continue
        now = -over[0] if over else None
        if cells and now == shown:
            cells[-1] = (cells[-1][0] + right - left, cells[-1][1])
        else:
            cells.append((right - left, spans[now].text if now is not None else ""))
        shown, x = now, right
    return cells


def fill_grid(rows: Sequence[list[tuple[int, int, str]]]) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """The rows of :func:`grid_rows`, filled up to the widest one. They are gone through twice, not held."""
    width = max((sum(columns for columns, _ in cells) for _, cells in grid_rows(rows)), default=0)
    for times, cells in grid_rows(rows):
        lacking = width - sum(columns for columns, _ in cells)
        yield times, [*cells, (lacking, "")] if lacking else cells


def _walk(element: ET.Element, section: str | None, blocks: list[dict], stats: dict) -> None:
    """Append paragraph and table blocks; tables nested in a block follow it."""
    for block in _top(element, "p", "tbl"):
        if block.tag == "tbl":
            _walk_table(block, section, blocks, stats)
            continue
        nested = list(_top(block, "tbl"))
        text = _text(block, nested)
        if text:
            stats["bullets"] += text.count(BULLET)
            blocks.append({"section": section, "kind": "paragraph", "text": text, "rows": None})
        for table in nested:
            _walk_table(table, section, blocks, stats)


def _walk_table(table: ET.Element, section: str | None, blocks: list[dict], stats: dict) -> None:
    rows, nested = [], []
    for line in _top(table, "tr"):
        row = []
        for cell in _top(line, "tc"):
            inner = list(_top(cell, "tbl"))
            row.append((_span(cell, "colspan"), _span(cell, "rowspan"), _text(cell, inner)))
            nested += inner
        rows.append(row)
        stats["cells"] += len(row)
    stats["tables"] += 1
    stats["rows"] += len(rows)
    grid = [
        {"times": times, "cells": [{"columns": columns, "text": text} for columns, text in cells]}
        for times, cells in fill_grid(rows)
    ]
    blocks.append({"section": section, "kind": "table", "text": None, "rows": grid})
    for inner in nested:
        _walk_table(inner, section, blocks, stats)


def parse_document(content: bytes) -> tuple[list[dict], dict]:
    """Blocks of all sections in numeric order, and counts."""
    blocks: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        sections = {i.filename: i for i in _safe_entries(archive) if SECTION.match(i.filename)}
        if not sections:
            raise DocumentError("no section XML found")
        stats = dict.fromkeys(_STAT_NAMES, 0) | {"sections": len(sections)}
        for name in sorted(sections, key=lambda n: int(SECTION.match(n)[1])):
            blocks.append({"section": name, "kind": "section", "text": f"<!-- {name} -->", "rows": None})
            _walk(_parse_xml(archive.read(sections[name])), name, blocks, stats)
    return blocks, stats


def _manifest_rows(notice: str, path: str, name: str, content: bytes) -> Iterator[dict]:
    prefix = re.match(r"(\d+)_", name)
    for sequence, original, data, reason in expand(name, content, prefix[1] if prefix else "0"):
        row = {
            "notice": notice,
            "sequence": sequence,
            "source": path,
            "original_name": original,
            "bytes": len(data),
            "reason": reason,
        }
        extension = _extension(original)
        if reason is not None:
            row["kind"] = "error" if reason.startswith("error: ") else "skipped"
        elif ROUTES.get(extension) == "pass":
            row["kind"] = extension[1:]
        elif ROUTES.get(extension) == "convert":
            try:
                row["blocks"], row["stats"] = parse_document(data)
                row["kind"] = extension[1:]
            except Exception as error:  # whatever is wrong with a file, the others go on
                row["kind"], row["reason"] = "error", str(error) or type(error).__name__
        else:
            row["kind"] = "skipped"
            row["reason"] = UNSUPPORTED + (extension or NO_EXTENSION)
        yield row


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for notice, path, name, content in zip(*(column for column in batch.columns), strict=True):
            for row in _manifest_rows(notice.as_py(), path.as_py(), name.as_py(), content.as_py()):
                held.append(row)
                size += row["bytes"]
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW_MANIFEST)
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW_MANIFEST)


def convert_documents(files: DataFrame) -> DataFrame:
    """Manifest: one row per document of the given files (notice, path, name, content).

    ``kind`` is hwpx, pdf, skipped or error. A file that cannot be read gives an error row and
    does not fail its notice. Bytes pass to Python once and do not come back.
    """
    return files.select("notice", "path", "name", "content").mapInArrow(_convert, MANIFEST)


def expand_archives(files: DataFrame) -> DataFrame:
    """Files with archives replaced by their documents: notice, sequence, name, content, reason."""
    schema = pa.schema(
        [("notice", _TEXT), ("sequence", _TEXT), ("name", _TEXT), ("content", pa.binary()), ("reason", _TEXT)]
    )

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for notice, name, content in zip(*batch.columns, strict=True):
                prefix = re.match(r"(\d+)_", name.as_py())
                for row in expand(name.as_py(), content.as_py(), prefix[1] if prefix else "0"):
                    yield notice.as_py(), *row

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in unpacked(batches):
            held.append(row)
            size += len(row[3])
            if size >= BATCH_BYTES:
                yield _record_batch(held, schema)
                held, size = [], 0
        if held:
            yield _record_batch(held, schema)

    return files.select("notice", "name", "content").mapInArrow(
        unpack, "notice string, sequence string, name string, content binary, reason string"
    )


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


_ARROW_PARSED = pa.struct(
    [("blocks", pa.list_(_ARROW_BLOCK)), ("stats", _ARROW_MANIFEST.field("stats").type), ("error", _TEXT)]
)


@F.arrow_udf(from_arrow_type(_ARROW_PARSED))
def section_blocks(xml: pa.Array) -> pa.Array:
    """(blocks, stats, error) of one section given as XML text."""
    parsed = []
    for text in xml:
        blocks: list[dict] = []
        stats = dict.fromkeys(_STAT_NAMES, 0) | {"sections": 1}
        try:
            _walk(_parse_xml(text.as_py()), None, blocks, stats)
            parsed.append({"blocks": blocks, "stats": stats, "error": None})
        except Exception as error:
            parsed.append({"blocks": None, "stats": None, "error": str(error) or type(error).__name__})
    return pa.array(parsed, type=_ARROW_PARSED)


# ---- blocks and text, inside the JVM


def table_rows(rows: Column) -> Column:
    """Table rows as arrays of texts, every span written out."""

    def written(row: Column) -> Column:
        cells = F.flatten(F.transform(row["cells"], lambda c: F.array_repeat(c["text"], c["columns"])))
        return F.array_repeat(cells, row["times"])

    return F.flatten(F.transform(rows, written))


def block_text(block: Column) -> Column:
    return F.when(block["kind"] == "table", let(table_rows(block["rows"]), markdown_table)).otherwise(block["text"])


def to_markdown(blocks: Column | str) -> Column:
    """One text per document: blocks in order, blank lines collapsed, newline at the end."""
    joined = F.array_join(F.transform(blocks, block_text), "\n\n")
    collapsed = F.trim(F.regexp_replace(joined, "\n{3,}", "\n\n"))
    return F.concat(F.regexp_replace(collapsed, r"^\s+|\s+$", ""), F.lit("\n"))


def document_blocks(documents: DataFrame, keys: list[str], blocks: str = "blocks") -> DataFrame:
    """One row per block with its position ``pos`` and ``text``."""
    exploded = explode_rows(documents, keys, F.col(blocks), "_block", "pos")
    return exploded.select(
        *keys,
        "pos",
        F.col("_block.section").alias("section"),
        F.col("_block.kind").alias("kind"),
        block_text(F.col("_block")).alias("text"),
    )


# Elements of a web page that hold blocks of text, those that a like one ends, and those without text.
BLOCK_ELEMENTS = (
    "html|head|title|body|nav|header|footer|main|article|section|aside|div|address|form|fieldset|"
    "h1|h2|h3|h4|h5|h6|p|pre|blockquote|ul|ol|li|dl|dt|dd|figure|figcaption|"
    "table|caption|thead|tbody|tfoot|tr|th|td"
)
ENDED_BY_LIKE = ("li", "dt", "dd", "tr", "th", "td")
_EVENT = re.compile(
    rf"(?P<skipped><!--.*?-->|<(script|style)\b.*?</\2\s*>)|<(?P<close>/?)(?P<name>{BLOCK_ELEMENTS})(?:[ \t\r\n\f/][^>]*)?>",
    re.IGNORECASE | re.DOTALL,
)
OUTSIDE = "text"
_ARROW_RUNS = pa.list_(pa.struct([("kind", _TEXT), ("text", _TEXT)]))


def text_runs(page: str) -> Iterator[tuple[str, str]]:
    """(kind, markup) of every run of a page between two block tags; the kind is the innermost open block element.

    A tag that opens ends an open paragraph, and a list item or table cell of its own kind; one that closes ends its
    element and all in it, or nothing if that is not open. Comments, scripts and styles hold no text.
    """
    stack: list[str] = []
    held: list[str] = []
    at = 0
    for event in _EVENT.finditer(page):
        held.append(page[at : event.start()])
        at = event.end()
        if event["skipped"]:
            held.append(" ")
            continue
        yield stack[-1] if stack else OUTSIDE, "".join(held)
        held = []
        name = event["name"].lower()
        if not event["close"]:
            if stack and (stack[-1] == "p" or stack[-1] == name and name in ENDED_BY_LIKE):
                stack.pop()
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    held.append(page[at:])
    yield stack[-1] if stack else OUTSIDE, "".join(held)


@F.arrow_udf(from_arrow_type(_ARROW_RUNS))
def _page_runs(pages: pa.Array) -> pa.Array:
    offsets, kinds, texts = [0], [], []
    for page in pages:
        for kind, text in text_runs(page.as_py() or ""):
            if not text.isspace() and text:
                kinds.append(kind)
                texts.append(text)
        offsets.append(len(kinds))
    runs = pa.StructArray.from_arrays([pa.array(kinds, _TEXT), pa.array(texts, _TEXT)], ["kind", "text"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)


def html_blocks(html: Column | str) -> Column:
    """All text of a web page as array of (kind, text), in order; blocks without text are left out."""
    runs = _page_runs(F.col(html) if isinstance(html, str) else html)
    blocks = F.transform(runs, lambda run: F.struct(run["kind"].alias("kind"), markup_text(run["text"]).alias("text")))
    return F.filter(blocks, lambda block: block["text"] != "")


def page_block_stats(pages: DataFrame, html: str = "html") -> DataFrame:
    """Counts per page: headings, paragraphs, list items and links, and bullets in its text."""
    tags = {"headings": "<h1[ >]", "paragraphs": "<p[ >]", "items": "<li[ >]", "links": "<a "}
    rest = [c for c in pages.columns if c != html]
    return pages.select(
        *rest,
        *[F.regexp_count(html, F.lit(pattern)).alias(name) for name, pattern in tags.items()],
        count_bullets(html).alias("bullets"),
    )
