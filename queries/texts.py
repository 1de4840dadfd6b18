"""Text, markup, name and id functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.functions import cells, ids, names, text
from noticeflow.operators import sets

from .tables import SQL_WS, slots, sql_normalise, table


def normalise_text(spark, sf_dir):
    squashed = text.squash_ws("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(text.normalise_ws("text")).alias("normalised"),
        F.md5(squashed).alias("squashed"),
        F.length(text.strip_ws("text")).alias("stripped_chars"),
    )


def bullet_spacing(spark, sf_dir):
    """Sentence ends of the documents written as bullets."""
    marked = F.regexp_replace("text", r"\. +", "◦")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.count_bullets(marked).alias("bullets"),
        F.md5(text.bullet_spacing(marked)).alias("spaced"),
    )


def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.markup_text("html")).alias("digest"))


PAGE_TEXT = r"""regexp_replace(html, '<[^>]+>', ' ', 'g')"""
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
    PAGE_TEXT = f"replace({PAGE_TEXT}, '{_entity}', '{_char}')"


def decode_entities(spark, sf_dir):
    """Numeric entities made from the lines' keys, some hexadecimal, some escaped twice."""
    code = F.lit(0xAC00) + F.col("l_partkey") % 1000
    written = F.concat(
        F.lit("a&#x"), F.lower(F.hex(code)), F.lit(";b&#"), (code + 1).cast("string"), F.lit(";c&#38;lt;d&amp;gt;&#1114112;")
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_partkey", text.decode_entities(written).alias("decoded")
    ).distinct()


def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escape("html")).alias("digest"))


def guess_name(spark, sf_dir):
    """Page addresses as attachment addresses, in six forms."""
    k = F.col("page_id")
    url = (
        F.when(k % 6 == 0, F.col("url"))
        .when(k % 6 == 1, F.concat("url", F.when(F.col("url").contains("?"), F.lit("&")).otherwise("?"), F.lit("fileName=%EB%AC%B8%EC%84%9C%20"), k, F.lit(".pdf")))
        .when(k % 6 == 2, F.concat(F.lit("https://h.example/p/q/doc+"), k, F.lit(".HWP#x")))
        .when(k % 6 == 3, F.concat(F.lit("https://h.example/view.jsp?fileSeq="), k))
        .when(k % 6 == 4, F.concat(F.lit("https://h.example/x?fileNm=%zz"), k))
        .otherwise(F.lit("not a url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", names.guess_name(url, k % 10).alias("name"))


def safe_name(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("a/b:"), "p_name", F.lit("?.pdf")))
        .when(k % 4 == 1, F.lit("..."))
        .when(k % 4 == 2, F.repeat(F.col("p_name"), 30))
        .otherwise(F.lit(""))
    )
    fallback = F.concat(F.lit("attachment_"), k.cast("string"))
    return parts.select(
        "p_partkey",
        names.safe_name(name, fallback).alias("safe"),
        names.numbered_name(k % 100, name, fallback).alias("target"),
        names.file_extension(name).alias("extension"),
    )


def _made_ids():
    """A text per line that carries ids glued to Hangul and with an en dash."""
    return F.concat(
        F.lit("가ECR-"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit("나 NW-"), F.col("l_suppkey"),
        F.lit(" ECR–HW-"), F.col("l_linenumber"), F.lit(" ECR-"), F.col("l_orderkey") + 10000, F.lit(" 가ECR-"),
        F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"),
    )


def extract_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("made", _made_ids())
    joined = lambda found: F.array_join(found, " ")
    return lines.select(
        *KEYS,
        joined(ids.extract_ids("made")).alias("strict"),
        joined(ids.extract_ids("made", ids.PROMPT_ID)).alias("prompt"),
        joined(ids.loose_ids("made")).alias("loose"),
        joined(ids.id_filter(F.array(F.lit(" ecr-1 "), F.lit("NW-2"), F.lit("ECR–3")))).alias("filtered"),
    )


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def document_ids(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(ids.loose_ids("text")).alias("id"))
    return sets.distinct_ids(found, ["doc_id"], "id")


def distinct_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.concat(F.lit("ECR-"), F.col("l_partkey") % 50))
    return sets.distinct_ids(lines, ["l_suppkey"], "id")


def excerpt_window(spark, sf_dir):
    window = ids.excerpt_window("text", F.lit("the"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(window).alias("chars"), F.md5(window).alias("digest"), F.md5(ids.head("text")).alias("head")
    )


def markdown_rows(spark, sf_dir):
    row = F.array("p_name", F.concat("p_brand", F.lit("|"), "p_type"), F.lit(""), F.concat(F.lit("a\n"), "p_size"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.markdown_row(row).alias("line"),
        text.markdown_table(F.array(F.array(F.lit("name"), F.lit("size")), F.array("p_name", F.col("p_size").cast("string")))).alias("whole"),
    )


def join_text(spark, sf_dir):
    values = F.array(
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(""),
        F.when(F.col("p_size") % 5 == 0, F.col("p_name")),
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.join_text(values).alias("joined"), text.join_text(values, " | ", None).alias("piped"))


def text_cells(spark, sf_dir):
    """Cells wrapped as text and read back, also from the older form."""
    lines = slots(spark, sf_dir)
    value = F.when(F.col("l_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('="'), "p_name", F.lit(',"')))
    return lines.select(
        *KEYS,
        cells.text_cell(value).alias("cell"),
        cells.untext_cell(cells.text_cell(value)).alias("back"),
        cells.untext_cell(F.concat(F.lit("="), "p_name")).alias("older"),
        cells.csv_escape(value).alias("escaped"),
    )


_MADE_SQL = """SELECT *, '가ECR-' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || '나 NW-' || l_suppkey || ' ECR–HW-' || l_linenumber
  || ' ECR-' || (l_orderkey + 10000) || ' 가ECR-' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS made FROM lineitem"""

QUERIES = {
    "normalise_text": (
        normalise_text,
        f"""SELECT doc_id, md5({sql_normalise('text')}) AS normalised,
          md5(regexp_replace(text, '{SQL_WS}', '', 'g')) AS squashed,
          CAST(length(regexp_replace(regexp_replace(text, '^{SQL_WS}+', ''), '{SQL_WS}+$', '')) AS INTEGER) AS stripped_chars
        FROM documents""",
    ),
    "bullet_spacing": (
        bullet_spacing,
        """WITH d AS (SELECT doc_id, regexp_replace(text, '\\. +', '◦', 'g') AS t FROM documents)
        SELECT doc_id, CAST(length(t) - length(replace(t, '◦', '')) AS INTEGER) AS bullets,
          md5(regexp_replace(t, ' *(◦) *', ' \\1 ', 'g')) AS spaced FROM d""",
    ),
    "page_text": (
        page_text,
        f"""SELECT page_id, md5(trim(regexp_replace(regexp_replace({PAGE_TEXT}, '[\\t\\r\\n ]+', ' ', 'g'),
          ' *([◦•]) *', ' \\1 ', 'g'), ' ')) AS digest FROM pages""",
    ),
    "decode_entities": (
        decode_entities,
        """SELECT DISTINCT l_partkey, 'a' || chr(CAST(44032 + l_partkey % 1000 AS INTEGER)) || 'b'
          || chr(CAST(44033 + l_partkey % 1000 AS INTEGER)) || 'c<d&gt;&#1114112;' AS decoded FROM lineitem""",
    ),
    "html_escape": (
        html_escape,
        """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
          '"', '&quot;'), '''', '&#39;')) AS digest FROM pages""",
    ),
    "guess_name": (
        guess_name,
        """SELECT page_id, CASE page_id % 6
          WHEN 0 THEN CASE WHEN instr(regexp_extract(url, '([^/?]*)(\\?|$)', 1), '.') > 0
                           THEN regexp_extract(url, '([^/?]*)(\\?|$)', 1) ELSE '첨부파일 ' || (page_id % 10 + 1) END
          WHEN 1 THEN '문서 ' || page_id || '.pdf' WHEN 2 THEN 'doc+' || page_id || '.HWP'
          WHEN 3 THEN '첨부파일 ' || page_id ELSE '첨부파일 ' || (page_id % 10 + 1) END AS name FROM pages""",
    ),
    "safe_name": (
        safe_name,
        """WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'b_' || p_name || '_.pdf' WHEN 1 THEN '_'
            WHEN 2 THEN trim(left(repeat(p_name, 30), 180), '') ELSE 'attachment_' || p_partkey END AS safe FROM part)
        SELECT p_partkey, safe, CASE WHEN p_partkey % 100 < 10 THEN '0' ELSE '' END || (p_partkey % 100) || '_' || safe AS target,
          CASE p_partkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.' ELSE '' END AS extension FROM n""",
    ),
    "extract_ids": (
        extract_ids,
        f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          'ECR-' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS strict,
          CASE WHEN i = n THEN i ELSE i || ' ECR–HW-' || l_linenumber || ' ' || n END AS prompt,
          i || ' NW-' || l_suppkey || ' ECR-HW-' || l_linenumber || CASE WHEN i = n THEN '' ELSE ' ' || n END AS loose,
          'ecr-1 ECR–3' AS filtered
        FROM (SELECT *, 'ECR-' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS i,
                'ECR-' || (l_orderkey + 10000) AS n FROM ({_MADE_SQL}))""",
    ),
    "document_ids": (
        document_ids,
        """SELECT DISTINCT doc_id, replace(id, '–', '-') AS id FROM (
          SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]{2,4}[-–][A-Z0-9-]+')) AS id FROM documents)""",
    ),
    "distinct_ids": (distinct_ids, "SELECT DISTINCT l_suppkey, 'ECR-' || (l_partkey % 50) AS id FROM lineitem"),
    "excerpt_window": (
        excerpt_window,
        """WITH d AS (SELECT doc_id, text, CASE WHEN instr(text, 'the') = 0 THEN -1
            ELSE length(text) - length(list_extract(string_split(text, 'the'), -1)) - 3 END AS p FROM documents),
        w AS (SELECT doc_id, text, CASE WHEN p < 0 THEN '[the 원문을 찾지 못함]'
            ELSE substring(text, greatest(p - 220, 0) + 1, least(p + 1350, length(text)) - greatest(p - 220, 0)) END AS win FROM d)
        SELECT doc_id, CAST(length(win) AS INTEGER) AS chars, md5(win) AS digest, md5(left(text, 6200)) AS head FROM w""",
    ),
    "markdown_rows": (
        markdown_rows,
        """SELECT p_partkey, '| ' || p_name || ' | ' || p_brand || '\\|' || p_type || ' |   | a<br>' || p_size || ' |' AS line,
          '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_size || ' |' AS whole
        FROM part""",
    ),
    "join_text": (
        join_text,
        """WITH v AS (SELECT p_partkey, list_filter([CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END,
            CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END, CASE WHEN p_size % 5 = 0 THEN p_name ELSE '' END],
            lambda x: x <> '') AS l FROM part)
        SELECT p_partkey, CASE WHEN len(l) = 0 THEN '-' ELSE array_to_string(l, ', ') END AS joined,
          array_to_string(l, ' | ') AS piped FROM v""",
    ),
    "text_cells": (
        text_cells,
        """WITH v AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE '="' || p_name || ',"' END AS v
            FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE v WHEN '' THEN '' ELSE '="' || v || '"' END AS cell,
          v AS back, p_name AS older, CASE v WHEN '' THEN '' ELSE '"' || replace(v, '"', repeat('"', 2)) || '"' END AS escaped FROM v""",
    ),
}
