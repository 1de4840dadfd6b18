"""Search, selection and browsing of notices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from noticeflow.functions import cells, dates, text
from noticeflow.operators import dedup, extraction, notices as ops, positions, reports, sets
from noticeflow.plans import programs
from noticeflow.plans.config import collect_config
from noticeflow.session import work_dir
from noticeflow.sources import landed
from noticeflow.sources.daily_csv import export_lines
from noticeflow.sources.store import daily_counts
from noticeflow.spec import BID, PRE

from .tables import NOTICES_SQL, notices, slots, sql_normalise, table

ORDER_LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def raw_records(spark, sf_dir):
    """Orders as records with the published field names of both kinds."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    pre = F.col("o_orderstatus") == "P"
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = (
        F.when(k % 4 == 0, day)
        .when(k % 4 == 1, F.concat(F.replace(day, F.lit("-"), F.lit(".")), F.lit(" 10:30")))
        .when(k % 4 == 2, F.concat(F.replace(day, F.lit("-"), F.lit("")), F.lit(" 1030")))
        .otherwise(F.lit(""))
    )
    base = "https://files.example/"
    url = lambda *parts: F.concat(F.lit(base), *parts)
    extension = F.element_at(F.array(*map(F.lit, (".hwp", ".hwpx", ".pdf", ".zip"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k,
        F.when(~pre, F.concat(F.lit(" "), key)).otherwise("").alias("bidNtceNo"),
        F.when(pre, key).alias("bfSpecRgstNo"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Office "), F.col("o_custkey") % 7)).alias("rlDminsttNm"),
        F.concat(F.lit("Agency "), F.col("o_custkey") % 5).alias("dminsttNm"),
        F.col("o_orderpriority").alias("prdctClsfcNoNm"),
        F.col("o_orderpriority").alias("bidNtceNm"),
        written.alias("rgstDt"),
        F.when(~pre, day).alias("bidNtceDt"),
        day.alias("opninRgstClseDt"),
        day.alias("bidClseDt"),
        F.lit("용역").alias("bsnsDivNm"),
        url(F.lit("get.do?fileNm=%EA%B7%9C%EA%B2%A9_"), key, extension).alias("specDocFileUrl1"),
        F.when(k % 2 == 0, url(F.lit("get.do?fileNm=%EA%B7%9C%EA%B2%A9_"), key, extension)).alias("specDocFileUrl2"),
        F.lit("ftp://files.example/a.hwp").alias("specDocFileUrl3"),
        url(F.lit("dir/"), key, extension, F.lit("?v=1")).alias("specDocFileUrl4"),
        url(F.lit("view.do?seq="), key).alias("specDocFileUrl5"),
        url(F.lit("b/1?id="), key).alias("ntceSpecDocUrl1"),
        F.concat(F.lit("Plan "), key, extension).alias("ntceSpecFileNm1"),
        F.when(k % 3 == 0, url(F.lit("b/3?id="), key)).alias("ntceSpecDocUrl3"),
        F.when(k % 3 == 0, url(F.lit("b/3?id="), key)).alias("ntceSpecDocUrl9"),
    )


RAW_SQL = """
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus = 'P' AS is_pre,
         o_custkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day,
         CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 1 THEN strftime(o_orderdate, '%Y.%m.%d') || ' 10:30'
              WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') || ' 1030' ELSE '' END AS written,
         CASE o_orderkey % 4 WHEN 0 THEN '.hwp' WHEN 1 THEN '.hwpx' WHEN 2 THEN '.pdf' ELSE '.zip' END AS ext
  FROM orders
"""
# The attachments that remain, in order, with their names.
FILES_SQL = f"""
  SELECT k, CASE WHEN is_pre THEN 'pre' ELSE 'bid' END AS mode, key AS number, slot, url, name,
         ext, day, written
  FROM (
    SELECT *, 1 AS slot, 'https://files.example/get.do?fileNm=%EA%B7%9C%EA%B2%A9_' || key || ext AS url,
           '규격_' || key || ext AS name FROM ({RAW_SQL}) WHERE is_pre
    UNION ALL
    SELECT *, 4, 'https://files.example/dir/' || key || ext || '?v=1', key || ext FROM ({RAW_SQL}) WHERE is_pre
    UNION ALL
    SELECT *, 5, 'https://files.example/view.do?seq=' || key, '첨부파일 ' || key FROM ({RAW_SQL}) WHERE is_pre
    UNION ALL
    SELECT *, 1, 'https://files.example/b/1?id=' || key, 'Plan ' || key || ext FROM ({RAW_SQL}) WHERE NOT is_pre
    UNION ALL
    SELECT *, 3, 'https://files.example/b/3?id=' || key, '첨부파일 3' FROM ({RAW_SQL}) WHERE NOT is_pre AND k % 3 = 0
  )
"""


def mapped(spark, sf_dir, keep=(), attach=True):
    mode = F.when(text.strip_ws("bidNtceNo") != "", BID.mode).otherwise(PRE.mode)
    return ops.map_records(raw_records(spark, sf_dir), mode, F.lit("용역"), keep, attach)


def map_notice(spark, sf_dir):
    return mapped(spark, sf_dir).drop("files", "notice_kind")


MAP_SQL = f"""
  SELECT CASE WHEN is_pre THEN 'pre' ELSE 'bid' END AS mode, key AS number,
         CASE WHEN is_pre AND k % 3 <> 0 THEN 'Office ' || (o_custkey % 7)
              ELSE 'Agency ' || (o_custkey % 5) END AS institution,
         '용역' AS business_type, o_orderpriority AS title,
         CASE WHEN is_pre THEN written ELSE day END AS published_at, day AS close_at
  FROM ({RAW_SQL})
"""


def search_notices(spark, sf_dir):
    """Notices of two institutions in 1997 whose title contains 'high', newest first."""
    # Period and institutions go to the source; copies are dropped before the title filter.
    asked = ops.date_range(notices(spark, sf_dir), "day", date(1997, 1, 1), date(1997, 12, 31))
    asked = ops.institution_any(asked, ["NATION_7", "NATION_12"])
    asked = asked.withColumn("number", F.col("number").cast("string"))
    first = dedup.keep_first(asked, "number", ["day", "title"])
    found = ops.match_filters(first, {"title": " H I G H "})
    attachments = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("number"))
    counted = ops.count_attachments(found, attachments, ["number"], selective=True)
    return ops.newest_first(counted, "day", "number")


SEARCH_SQL = f"""
  WITH n AS ({NOTICES_SQL})
  SELECT mode, CAST(number AS VARCHAR) AS number, institution, business_type, title, day, amount,
         (SELECT count(*) FROM lineitem WHERE l_orderkey = number) AS attachments
  FROM n
  WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
    AND (institution LIKE '%NATION_7%' ESCAPE '~' AND instr(institution, 'NATION_7') > 0
         OR instr(institution, 'NATION_12') > 0)
    AND instr(lower(title), 'high') > 0
  ORDER BY day DESC, CAST(number AS VARCHAR)
"""


def filter_compact(spark, sf_dir):
    return ops.match_filters(
        notices(spark, sf_dir), {"title": "Not  Specified customer#0000001", "business_type": "mach inery", "institution": None}
    ).select("number", "title", "business_type")


def keyword_search(spark, sf_dir):
    found = notices(spark, sf_dir).withColumn("number", F.col("number").cast("string"))
    return ops.keyword_search(found, " NATION_3 1-urgent ").select("number", "institution", "title")


def date_range(spark, sf_dir):
    found = ops.date_range(notices(spark, sf_dir), "day", date(1996, 2, 1), date(1996, 2, 29), date(2024, 1, 1))
    return found.select("number", "day")


def optional_equals(spark, sf_dir):
    found = ops.optional_equals(notices(spark, sf_dir), mode="pre", business_type="MACHINERY", institution="")
    return found.select("number", "mode", "business_type")


def institution_any(spark, sf_dir):
    return ops.institution_any(notices(spark, sf_dir), ["_1", "NATION_20"]).select("number", "institution")


def file_pattern(spark, sf_dir):
    matched = mapped(spark, sf_dir).withColumn("files", ops.file_pattern("files", r"^(규격|plan).*\.hwpx?$"))
    return ops.explode_files(matched).select("mode", "number", "slot", "name")


def latest_window(spark, sf_dir):
    return ops.latest_window(notices(spark, sf_dir), "day", 7).select("number", "day")


def keep_first(spark, sf_dir):
    # The digest of a text stands for the text, so texts are not shuffled.
    keyed = table(spark, sf_dir, "documents").select(
        F.sha2(text.normalise_ws("text"), 256).alias("key"), "doc_id"
    )
    return dedup.keep_first(keyed, "key", "doc_id", copies="copies").select("doc_id", "copies")


def latest_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return dedup.latest_per_key(events, "user_id", "ts", "event_id").select(
        "user_id", "event_id", "event_type", "value"
    )


def last_write_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return dedup.last_write_wins(events, ["user_id", "event_type"], "event_id", position="first_seen")


def slot_number(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    numbered = positions.slot_number(returned, ["l_orderkey"], ORDER_LINES)
    return numbered.select("l_orderkey", *ORDER_LINES[:3], "slot", "slot_label")


def top_then_filter(spark, sf_dir):
    rows = mapped(spark, sf_dir, keep=["o_orderkey"], attach=False)
    selected = ops.select_attachments(rows, 500, r"\.hwpx?$", "published_at", "o_orderkey")
    return ops.download_list(selected).select("mode", "number", "slot", "url", "name", "target")


def result_page(spark, sf_dir):
    found = notices(spark, sf_dir).select("number", "title", "day")
    return positions.page(found, ["day", "number"], number=3, descending=["day"])


def union_columns(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    pre = raw.where("bidNtceNo = ''").select(F.col("bfSpecRgstNo").alias("a"), F.col("o_orderkey").cast("string").alias("key"))
    bid = raw.where("bidNtceNo <> ''").select(F.col("o_orderkey").cast("string").alias("key"), F.col("bidClseDt").alias("b"))
    return sets.union_columns(pre, bid)


def record_key(spark, sf_dir):
    """Some records carry both numbers: the tender number then decides."""
    raw = raw_records(spark, sf_dir)
    k = F.col("o_orderkey")
    both = raw.withColumns(
        {
            "bfSpecRgstNo": F.when(k % 5 == 0, F.lit("")).when(k % 7 == 0, F.concat(F.lit("P"), k)).otherwise(F.col("bfSpecRgstNo")),
        }
    )
    read = ops.field_reader(both)
    return both.select("o_orderkey", ops.record_mode(read).alias("mode"), ops.record_key(read).alias("record_key"))


def date_keys(spark, sf_dir):
    return raw_records(spark, sf_dir).select(
        "o_orderkey",
        dates.record_day("rgstDt").alias("day"),
        dates.digits8("rgstDt").alias("digits"),
        dates.date_display("rgstDt").alias("shown"),
    )


def unpivot_attachments(spark, sf_dir):
    return ops.explode_files(mapped(spark, sf_dir)).select("mode", "number", "slot", "url", "name")


def attachment_count(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"))
    return ops.count_attachments(found, lines, ["number"])


def export_attachments(spark, sf_dir):
    rows = mapped(spark, sf_dir).withColumn("title", F.concat("title", F.lit(', "x"')))
    return export_lines(rows, ["mode", "number", "title", "published_at", "files"]).select("number", "line")


def attach_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("verified"))
    status = F.when(F.col("verified"), "pass").when(~F.col("verified"), "check").otherwise("none")
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ops.attach_analysis(documents, labels, ["doc_id"]).withColumn("status", status)


def run_summary(spark, sf_dir):
    """Every record arrives twice; one business type's requests failed."""
    rows = mapped(spark, sf_dir).select("number", ops.attachment_count().alias("attachments"))
    twice = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    kept = dedup.keep_first(twice, "number", "seq", copies="copies_dropped")
    jobs = table(spark, sf_dir, "events").select(F.to_date("ts").alias("chunk"), "event_type").distinct()
    return reports.run_summary(kept, jobs.where("event_type = 'error'"), jobs)


def _dated(spark, sf_dir):
    return notices(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def in_job_scope(spark, sf_dir):
    """Rows that a job of one mode, type and half a year replaces."""
    scope = ops.in_job_scope("bid", "1996-01-01", "1996-06-30", "BUILDING")
    return _dated(spark, sf_dir).where(scope).select("number", "day")


def drop_columns(spark, sf_dir):
    return ops.drop_columns(table(spark, sf_dir, "documents"), ["text", "lang", "no such column"])


def configured_plan(spark, sf_dir):
    """Orders per planned chunk of a configuration with unknown modes and types."""
    raw = {"begin": "1995-01-01", "end": "1995-07-04", "modes": ["본공고", "x"], "businessTypes": ["용역", "y"]}
    plan = programs.collect_plan(spark, collect_config(raw, date(2000, 1, 1)))
    days = plan.select("*", F.explode(F.sequence("chunk_begin", "chunk_end")).alias("day"))
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return days.join(orders, "day", "left").groupBy("mode", "business_type", "chunk_begin", "chunk_end").agg(
        F.count("o_orderkey").alias("orders")
    )


def order_as_expected(spark, sf_dir):
    """Lines in the order of the expected list, which leaves some out and asks for others in vain."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("id")).agg(
        F.max("l_quantity").alias("quantity")
    )
    listed = F.array(*map(F.lit, ["3", "9", "1"]))
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), listed.alias("ids"))
    placed = extraction.order_as_expected(items, expected, ["l_orderkey"], "ids", "id")
    at = placed.withColumn("at", F.monotonically_increasing_id())
    before = F.lag("id").over(Window.partitionBy("l_orderkey").orderBy("at"))
    return at.select("l_orderkey", "id", "quantity", before.alias("before"))


def take_sorted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return landed.take_sorted(lines, "l_orderkey", 100)


def index_roundtrip(spark, sf_dir):
    """The index of days as JSON lines, read back."""
    path = work_dir(spark, "index")
    landed.write_index(daily_counts(_dated(spark, sf_dir)), path, ["day", "mode"])
    return spark.read.schema("mode string, day string, count long").json(path)


def extension_share(spark, sf_dir):
    files = ops.explode_files(mapped(spark, sf_dir))
    return reports.extension_share(files, "name", F.col("name").rlike("(?i)^plan"))


def json_or_default(spark, sf_dir):
    props = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props"))
    parsed = cells.json_or_default(props, "map<string,bigint>", F.create_map(F.lit("k"), F.lit(-1).cast("long")))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(parsed, "k").alias("k"))


QUERIES = {
    "in_job_scope": (
        in_job_scope,
        f"""SELECT number, strftime(day, '%Y-%m-%d') AS day FROM ({NOTICES_SQL})
        WHERE mode = 'bid' AND business_type = 'BUILDING' AND day BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'""",
    ),
    "drop_columns": (drop_columns, "SELECT doc_id, source, n_chars FROM documents"),
    "configured_plan": (
        configured_plan,
        """WITH c AS (SELECT DATE '1995-01-01' + CAST(i * 28 AS INTEGER) AS b FROM range(7) r(i)),
        p AS (SELECT b, least(b + 27, DATE '1995-07-04') AS e FROM c)
        SELECT 'bid' AS mode, '용역' AS business_type, b AS chunk_begin, e AS chunk_end, count(o_orderkey) AS orders
        FROM p LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN b AND e GROUP BY b, e""",
    ),
    "order_as_expected": (
        order_as_expected,
        """WITH i AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS id, max(l_quantity) AS quantity FROM lineitem
          WHERE l_linenumber IN (1, 3) GROUP BY 1, 2)
        SELECT *, lag(id) OVER (PARTITION BY l_orderkey ORDER BY id DESC) AS before FROM i""",
    ),
    "take_sorted": (
        take_sorted,
        """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
        WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 100)""",
    ),
    "index_roundtrip": (
        index_roundtrip,
        f"SELECT mode, strftime(day, '%Y-%m-%d') AS day, count(*) AS count FROM ({NOTICES_SQL}) GROUP BY 1, 2",
    ),
    "search_notices": (search_notices, SEARCH_SQL),
    "map_notice": (map_notice, MAP_SQL),
    "filter_compact": (
        filter_compact,
        f"""SELECT number, title, business_type FROM ({NOTICES_SQL})
        WHERE instr(lower(replace(title, ' ', '')), 'notspecifiedcustomer#0000001') > 0
          AND business_type = 'MACHINERY'""",
    ),
    "keyword_search": (
        keyword_search,
        f"""SELECT CAST(number AS VARCHAR) AS number, institution, title FROM ({NOTICES_SQL})
        WHERE instr(lower(CAST(number AS VARCHAR) || ' ' || institution || ' ' || title), 'nation_3 1-urgent') > 0""",
    ),
    "date_range": (
        date_range,
        f"SELECT number, day FROM ({NOTICES_SQL}) WHERE day >= DATE '1996-02-01' AND day < DATE '1996-03-01'",
    ),
    "optional_equals": (
        optional_equals,
        f"""SELECT number, mode, business_type FROM ({NOTICES_SQL})
        WHERE mode = 'pre' AND business_type = 'MACHINERY'""",
    ),
    "institution_any": (
        institution_any,
        f"""SELECT number, institution FROM ({NOTICES_SQL})
        WHERE instr(institution, '_1') > 0 OR institution = 'NATION_20'""",
    ),
    "file_pattern": (
        file_pattern,
        f"""SELECT mode, number, slot, name FROM ({FILES_SQL})
        WHERE (name LIKE '규격%' OR name LIKE 'Plan%') AND (name LIKE '%.hwp' OR name LIKE '%.hwpx')""",
    ),
    "latest_window": (
        latest_window,
        f"""WITH n AS ({NOTICES_SQL}) SELECT number, day FROM n
        WHERE day > (SELECT max(day) FROM n) - INTERVAL 7 DAY""",
    ),
    "keep_first": (
        keep_first,
        f"""SELECT min(doc_id) AS doc_id, count(*) - 1 AS copies FROM documents
        GROUP BY {sql_normalise('text')}""",
    ),
    "latest_per_key": (
        latest_per_key,
        """SELECT user_id, event_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""",
    ),
    "last_write_wins": (
        last_write_wins,
        """SELECT user_id, event_type, event_id, value, first_seen FROM (
          SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_seen FROM events)
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
    ),
    "slot_number": (
        slot_number,
        f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, slot,
          CASE WHEN slot < 10 THEN '0' ELSE '' END || slot AS slot_label
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER_LINES)}) AS slot
              FROM lineitem WHERE l_returnflag = 'R')""",
    ),
    "top_then_filter": (
        top_then_filter,
        f"""WITH top AS (
          SELECT k FROM ({RAW_SQL})
          ORDER BY CASE WHEN is_pre THEN written ELSE day END DESC, k LIMIT 500),
        f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY slot) AS n
              FROM ({FILES_SQL}) WHERE k IN (SELECT k FROM top)
                AND (name LIKE '%.hwp' OR name LIKE '%.hwpx'))
        SELECT mode, number, CAST(n AS INTEGER) AS slot, url, name, '0' || n || '_' || name AS target FROM f""",
    ),
    "result_page": (
        result_page,
        f"""WITH n AS ({NOTICES_SQL})
        SELECT number, title, day, 3 AS page, CAST(ceil((SELECT count(*) FROM n) / 50.0) AS INTEGER) AS pages
        FROM n ORDER BY day DESC, number LIMIT 50 OFFSET 100""",
    ),
    "union_columns": (
        union_columns,
        f"""SELECT CASE WHEN is_pre THEN key ELSE '' END AS a, key,
          CASE WHEN is_pre THEN '' ELSE day END AS b FROM ({RAW_SQL})""",
    ),
    "record_key": (
        record_key,
        f"""SELECT k AS o_orderkey, mode, CASE mode WHEN '' THEN '' ELSE mode || ':' || number END AS record_key FROM (
          SELECT k, CASE WHEN NOT is_pre THEN 'bid' WHEN k % 5 = 0 THEN '' ELSE 'pre' END AS mode,
            CASE WHEN NOT is_pre THEN key WHEN k % 7 = 0 THEN 'P' || key ELSE key END AS number FROM ({RAW_SQL}))""",
    ),
    "date_keys": (
        date_keys,
        f"""SELECT k AS o_orderkey, CASE WHEN k % 4 = 3 THEN 'undated' ELSE day END AS day,
          CASE WHEN k % 4 = 3 THEN '' ELSE replace(day, '-', '') END AS digits,
          CASE WHEN k % 4 = 3 THEN '-' ELSE day END AS shown FROM ({RAW_SQL})""",
    ),
    "unpivot_attachments": (unpivot_attachments, f"SELECT mode, number, slot, url, name FROM ({FILES_SQL})"),
    "attachment_count": (
        attachment_count,
        """SELECT o_orderkey AS number, count(l_orderkey) AS attachments
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    ),
    "export_attachments": (
        export_attachments,
        f"""SELECT key AS number, (CASE WHEN is_pre THEN 'pre' ELSE 'bid' END) || ',' || key || ',"' || o_orderpriority
            || ', ' || repeat('"', 2) || 'x' || repeat('"', 3) || ',' || (CASE WHEN is_pre THEN written ELSE day END) || ',' || files AS line
        FROM ({RAW_SQL}) r JOIN (
          SELECT k, string_agg(name || ' (' || url || ')', ' | ' ORDER BY slot) AS files FROM ({FILES_SQL}) GROUP BY k
        ) f ON r.k = f.k""",
    ),
    "attach_labels": (
        attach_labels,
        """SELECT d.doc_id, d.source, quality = 1 AS verified,
          CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'check' ELSE 'none' END AS status
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "run_summary": (
        run_summary,
        f"""SELECT (SELECT count(*) FROM orders) AS notices, (SELECT count(*) FROM ({FILES_SQL})) AS attachments,
          (SELECT count(*) FROM orders) AS copies_dropped,
          (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events WHERE event_type = 'error') AS errors,
          (SELECT count(*) FROM (SELECT DISTINCT CAST(ts AS DATE), event_type FROM events)) AS jobs,
          (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AS chunks""",
    ),
    "extension_share": (
        extension_share,
        f"""WITH f AS (SELECT regexp_extract(name, '(\\.[^.]*)$', 1) AS extension, name LIKE 'Plan%' AS m
          FROM ({FILES_SQL}))
        SELECT extension, count(*) AS files, count(*) FILTER (m) AS matched,
          round(count(*) / (SELECT count(*) FROM f), 6) AS share,
          round(count(*) FILTER (m) / (SELECT count(*) FROM f WHERE m), 6) AS matched_share
        FROM f GROUP BY extension""",
    ),
    "json_or_default": (
        json_or_default,
        """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(props ->> '$.k' AS BIGINT) END AS k
        FROM events""",
    ),
}
