"""Document blocks, tables, Markdown and counts."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from noticeflow.functions import text
from noticeflow.functions.nested import explode_rows
from noticeflow.operators import documents as docs, positions, reports
from noticeflow.operators.notices import natural_order
from noticeflow.plans import programs

from .tables import NOTICES_SQL, notices, table
from .texts import PAGE_TEXT


def page_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    blocks = explode_rows(pages, ["page_id"], docs.html_blocks("html"), "_b", "pos")
    return blocks.select("page_id", "pos", "_b.kind", F.md5("_b.text").alias("digest"))


def page_block_stats(spark, sf_dir):
    return docs.page_block_stats(table(spark, sf_dir, "pages").select("page_id", "html"))


def page_markdown(spark, sf_dir):
    blocks = F.transform(
        docs.html_blocks("html"),
        lambda b: F.struct(
            F.lit("").alias("section"),
            F.lit("paragraph").alias("kind"),
            b["text"].alias("text"),
            F.lit(None).cast(docs.GRID).alias("rows"),
        ),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.md5(docs.to_markdown(blocks)).alias("digest"))


def notice_xml(spark, sf_dir):
    """One section per notice: a paragraph, and a table with column and row spans."""
    k = F.col("number")
    cell = lambda value, attributes="": F.concat(
        F.lit(f"<hp:tc {attributes}><hp:p><hp:t>"), value, F.lit("</hp:t></hp:p></hp:tc>")
    )
    row = lambda *cells: F.concat(F.lit("<hp:tr>"), *cells, F.lit("</hp:tr>"))
    name = text.html_escape(F.concat("business_type", F.lit(" & <"), "institution", F.lit(">|")))
    span = F.concat(
        F.lit('<hp:tc rowSpan="'), 1 + k % 2, F.lit('"><hp:p><hp:t>'), "mode", F.lit("</hp:t></hp:p></hp:tc>")
    )
    last = F.when(k % 2 == 1, row(cell(F.lit("b")), cell(F.lit("2")))).otherwise(
        row(cell(F.lit("-")), cell(F.lit("b")), cell(F.lit("2")))
    )
    xml = F.concat(
        F.lit('<hp:sec xmlns:hp="urn:h"><hp:p><hp:t>'), "title", F.lit("</hp:t><hp:t>◦one◦  two</hp:t></hp:p><hp:tbl>"),
        row(cell(name, 'colSpan="2"'), cell(F.lit("n"))), row(span, cell(F.lit("a")), cell(k.cast("string"))), last,
        F.lit("</hp:tbl></hp:sec>"),
    )
    return notices(spark, sf_dir).select("number", xml.alias("xml"))


def grid_fill(spark, sf_dir):
    parsed = notice_xml(spark, sf_dir).select("number", docs.section_blocks("xml").alias("p"))
    return parsed.select(
        "number",
        docs.to_markdown(F.col("p.blocks")).alias("markdown"),
        "p.stats.tables", "p.stats.rows", "p.stats.cells", "p.stats.bullets",
    )


def document_blocks(spark, sf_dir):
    parsed = notice_xml(spark, sf_dir).select("number", docs.section_blocks("xml").alias("p"))
    blocks = docs.document_blocks(parsed.select("number", "p.blocks"), ["number"])
    return blocks.select("number", "pos", "kind", F.length("text").alias("chars"))


def grid_columns(spark, sf_dir):
    """Cells of a table row: the lines of one order and slot."""
    cells = table(spark, sf_dir, "lineitem").withColumn("col_span", (1 + F.col("l_quantity") % 3).cast("int"))
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    placed = positions.grid_columns(cells, ["l_orderkey", "l_linenumber"], order)
    return placed.select("l_orderkey", "l_linenumber", *order, "col_span", "start_col")


def _zipped(files: dict[str, bytes]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
        for name, data in files.items():
            out.writestr(zipfile.ZipInfo(name), data)
    return raw.getvalue()


def _section(text: str, encoding: str = "UTF-8") -> bytes:
    head = f'<?xml version="1.0" encoding="{encoding}"?><hp:sec xmlns:hp="urn:h"><hp:p><hp:t>'
    return (head + escape(text) + "</hp:t></hp:p></hp:sec>").encode(encoding)


def _attached(kind: int, text: str) -> bytes:
    """A file of one of eight kinds around a text: documents, archives, nested, broken and without documents."""
    document = {"Contents/section0.xml": _section(text)}
    if kind == 2:
        document = {"Contents/section10.xml": _section("tail"), "Contents/section2.xml": _section(text, "UTF-16")}
    whole = _zipped(document)
    if kind <= 2:
        return whole
    if kind == 3:
        return whole[: len(whole) // 2]
    if kind == 4:
        broken = _zipped({"Contents/section0.xml": b"<hp:sec xmlns:hp='urn:h'><hp:p>"})
        inner = _zipped({"b.pdf": text.encode(), "c.hwpx": broken, "../d.pdf": b"x"})
        return _zipped({"\uba74/\ud55c\uae00.hwpx": whole, "note.txt": b"x", "in.zip": inner})
    return _zipped({"readme.txt": text.encode()}) if kind == 6 else text.encode()


@F.arrow_udf(BinaryType())
def _attachment(kinds: pa.Array, texts: pa.Array) -> pa.Array:
    return pa.array([_attached(k.as_py(), t.as_py()) for k, t in zip(kinds, texts, strict=True)], pa.binary())


_FILE_NAMES = ("01_d.hwpx", "01_d.hwpx", "01_d.hwpx", "01_d.zip", "02_d.ZIP", "03_d.pdf", "04_d.zip", "05_d")


def attached_files(spark, sf_dir):
    """Files of eight kinds made from the documents."""
    kind = (F.col("doc_id") % 8).cast("int")
    plain = F.trim(F.regexp_replace("text", r"[\x00-\x20]+", " "))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("notice"),
        F.lit("/files").alias("path"),
        F.element_at(F.array(*map(F.lit, _FILE_NAMES)), kind + 1).alias("name"),
        _attachment(kind, plain).alias("content"),
    )


def convert_documents(spark, sf_dir):
    made = programs.texts(attached_files(spark, sf_dir))
    reason = F.when(F.col("kind") != "error", F.col("reason"))
    digest = F.when(F.col("kind") == "hwpx", F.md5("markdown"))
    return made.select("notice", "sequence", "original_name", "kind", reason.alias("reason"), digest.alias("digest"))


def expand_archives(spark, sf_dir):
    opened = docs.expand_archives(attached_files(spark, sf_dir))
    digest = F.when(F.lower("name").endswith(".pdf"), F.md5("content"))
    return opened.select(
        "notice", "sequence", "name", digest.alias("digest"), F.coalesce(F.col("reason").startswith("error: "), F.lit(False)).alias("failed")
    )


def kind_summary(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "hwpx").when(F.col("lang") == "fr", "pdf").otherwise("skipped")
    manifest = table(spark, sf_dir, "documents").select(
        "source", kind.alias("kind"), F.when(~F.col("lang").isin("en", "fr"), F.col("lang")).alias("reason")
    )
    return reports.kind_summary(manifest, ["source"])


def route_documents(spark, sf_dir):
    """Routes by extension over page and part names."""
    k = F.col("p_partkey")
    extension = F.element_at(F.array(*map(F.lit, (".hwpx", ".PDF", ".Zip", ".hwp", ".xlsx", ""))), (k % 6 + 1).cast("int"))
    name = F.concat(F.lit("dir.d/"), F.replace("p_name", F.lit(" "), F.lit("_")), extension)
    return table(spark, sf_dir, "part").select("p_partkey", docs.route(name).alias("route"))


def estimate_tokens(spark, sf_dir):
    binary = F.col("lang") == "fr"
    chars = reports.document_chars(F.when(~binary, F.col("text")), F.octet_length("text"))
    return reports.estimate_tokens(table(spark, sf_dir, "documents"), chars, ["source"])


def natural_sort(spark, sf_dir):
    """Sources src0 .. src19 in numeric order, as positions."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    return positions.running(sources, [], natural_order("source"), "pos")


_XML_TITLE = "title || ' ◦ one ◦ two'"

# Walks all pages at once, a block tag a round, with the open elements as a list.
_BLOCKS_SQL = rf"""
  WITH RECURSIVE p AS (SELECT page_id, regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
      '(?i)<(/?)({docs.BLOCK_ELEMENTS})(?:[ \t\r\n\f/][^>]*)?>', chr(1) || '\1\2' || chr(2), 'g') AS html FROM pages),
  s AS (SELECT page_id, string_split(html, chr(1)) AS l FROM p),
  e AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS piece FROM s),
  f AS (SELECT page_id, i, CASE WHEN i = 1 THEN '' ELSE lower(string_split(piece, chr(2))[1]) END AS tag,
      CASE WHEN i = 1 THEN piece ELSE string_split(piece, chr(2))[2] END AS html FROM e),
  w AS (
    SELECT page_id, i, html, CAST([] AS VARCHAR[]) AS open FROM f WHERE i = 1
    UNION ALL
    SELECT f.page_id, f.i, f.html, CASE
      WHEN tag[1] <> '/' AND (open[-1] = 'p' OR open[-1] = tag AND tag IN ('li', 'dt', 'dd', 'tr', 'th', 'td'))
        THEN list_append(open[:-2], tag)
      WHEN tag[1] <> '/' THEN list_append(open, tag)
      WHEN list_contains(open, tag[2:]) THEN open[:len(open) - list_position(list_reverse(open), tag[2:])]
      ELSE open END
    FROM w JOIN f ON f.page_id = w.page_id AND f.i = w.i + 1),
  c AS (SELECT page_id, i AS pos, coalesce(open[-1], 'text') AS kind, html FROM w)
"""
_BLOCK_TEXT = (
    rf"trim(regexp_replace(regexp_replace({PAGE_TEXT}, '[\t\r\n ]+', ' ', 'g'), ' *([◦•]) *', ' \1 ', 'g'), ' ')"
)

# Files of the documents by kind, as rows of what is in them.
_FILES_SQL = rf"""
  WITH d AS (SELECT doc_id % 8 AS k, CAST(doc_id AS VARCHAR) AS notice, trim(regexp_replace(text, '[\x00-\x20]+', ' ', 'g')) AS t FROM documents),
  c AS (SELECT *, trim(regexp_replace(t, ' *([◦•]) *', ' \1 ', 'g')) AS p FROM d),
  f AS (
    SELECT notice, '01' AS sequence, '01_d.hwpx' AS name, 'hwpx' AS kind, NULL AS reason,
      CASE WHEN k < 2 THEN '<!-- Contents/section0.xml -->' ELSE '<!-- Contents/section2.xml -->' END || chr(10) || chr(10)
        || p || chr(10) || CASE WHEN k < 2 THEN '' ELSE chr(10) || '<!-- Contents/section10.xml -->' || chr(10) || chr(10)
        || 'tail' || chr(10) END AS markdown, NULL AS content FROM c WHERE k <= 2
    UNION ALL SELECT notice, '01', '01_d.zip', 'error', NULL, NULL, NULL FROM c WHERE k = 3
    UNION ALL SELECT notice, '021', '면/한글.hwpx', 'hwpx', NULL,
      '<!-- Contents/section0.xml -->' || chr(10) || chr(10) || p || chr(10), NULL FROM c WHERE k = 4
    UNION ALL SELECT notice, '0221', 'b.pdf', 'pdf', NULL, NULL, t FROM c WHERE k = 4
    UNION ALL SELECT notice, '0222', 'c.hwpx', 'error', NULL, NULL, NULL FROM c WHERE k = 4
    UNION ALL SELECT notice, '03', '03_d.pdf', 'pdf', NULL, NULL, t FROM c WHERE k = 5
    UNION ALL SELECT notice, '04', '04_d.zip', 'skipped', '{docs.EMPTY_ARCHIVE}', NULL, NULL FROM c WHERE k = 6
    UNION ALL SELECT notice, '05', '05_d', 'skipped', '{docs.UNSUPPORTED}{docs.NO_EXTENSION}', NULL, NULL FROM c WHERE k = 7)
"""

QUERIES = {
    "convert_documents": (
        convert_documents,
        f"{_FILES_SQL} SELECT notice, sequence, name AS original_name, kind, reason, md5(markdown) AS digest FROM f",
    ),
    "expand_archives": (
        expand_archives,
        f"""{_FILES_SQL} SELECT notice, sequence, name, md5(content) AS digest, kind = 'error' AND name LIKE '%.zip' AS failed FROM f""",
    ),
    "page_blocks": (
        page_blocks,
        f"""{_BLOCKS_SQL}, t AS (SELECT page_id, pos, kind, {_BLOCK_TEXT} AS t FROM c)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, kind, md5(t) AS digest
        FROM t WHERE t <> ''""",
    ),
    "page_block_stats": (
        page_block_stats,
        """SELECT page_id, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS INTEGER) AS headings,
          CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS paragraphs,
          CAST(len(regexp_extract_all(html, '<li[ >]')) AS INTEGER) AS items,
          CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS links,
          CAST(length(html) - length(replace(html, '◦', '')) AS INTEGER) AS bullets FROM pages""",
    ),
    "page_markdown": (
        page_markdown,
        f"""{_BLOCKS_SQL}, t AS (SELECT page_id, pos, {_BLOCK_TEXT} AS t FROM c)
        SELECT page_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY pos) || chr(10)) AS digest FROM t WHERE t <> '' GROUP BY page_id""",
    ),
    "grid_fill": (
        grid_fill,
        rf"""WITH n AS (SELECT *, '| ' || business_type || ' & <' || institution || '>\|' AS h FROM ({NOTICES_SQL}))
        SELECT number, {_XML_TITLE} || chr(10) || chr(10) || h || ' ' || h || ' | n |' || chr(10) || '| --- | --- | --- |' || chr(10)
          || '| ' || mode || ' | a | ' || number || ' |' || chr(10)
          || '| ' || CASE WHEN number % 2 = 1 THEN mode ELSE '-' END || ' | b | 2 |' || chr(10) AS markdown,
          1 AS tables, 3 AS rows, CASE WHEN number % 2 = 1 THEN 7 ELSE 8 END AS cells, 2 AS bullets FROM n""",
    ),
    "document_blocks": (
        document_blocks,
        rf"""WITH n AS (SELECT *, '| ' || business_type || ' & <' || institution || '>\|' AS h FROM ({NOTICES_SQL}))
        SELECT number, 0 AS pos, 'paragraph' AS kind, CAST(length({_XML_TITLE}) AS INTEGER) AS chars FROM n
        UNION ALL
        SELECT number, 1, 'table', CAST(length(h || ' ' || h || ' | n |') + length('| --- | --- | --- |') + 3
          + length('| ' || mode || ' | a | ' || number || ' |')
          + length('| ' || CASE WHEN number % 2 = 1 THEN mode ELSE '-' END || ' | b | 2 |') AS INTEGER) FROM n""",
    ),
    "grid_columns": (
        grid_columns,
        """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
            CAST(1 + l_quantity % 3 AS INTEGER) AS col_span FROM lineitem)
        SELECT *, CAST(coalesce(sum(col_span) OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_col FROM c""",
    ),
    "kind_summary": (
        kind_summary,
        """SELECT source, count(*) FILTER (lang = 'en') AS hwpx, count(*) FILTER (lang = 'fr') AS pdf,
          count(*) FILTER (lang NOT IN ('en', 'fr')) AS skipped FROM documents GROUP BY source""",
    ),
    "route_documents": (
        route_documents,
        """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'convert' WHEN 1 THEN 'pass' WHEN 2 THEN 'expand' ELSE 'skip' END AS route
        FROM part""",
    ),
    "estimate_tokens": (
        estimate_tokens,
        """WITH d AS (SELECT source, count(*) AS documents, CAST(sum(CASE WHEN lang = 'fr' THEN ceil(strlen(text) / 2.0)
            ELSE length(text) END) AS BIGINT) AS chars FROM documents GROUP BY source)
        SELECT source, documents, chars, CAST(ceil(chars / 1.2) AS BIGINT) AS tokens,
          round(ceil(chars / 1.2) / 1000000 * 5 + documents * 0.08, 6) AS cost FROM d""",
    ),
    "natural_sort": (
        natural_sort,
        """SELECT source, row_number() OVER (ORDER BY CAST(regexp_extract(source, '[0-9]+') AS INTEGER)) AS pos
        FROM (SELECT DISTINCT source FROM documents)""",
    ),
}
