"""Requests, answers, verification and reports on requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.functions import ids
from noticeflow.operators import excerpts, extraction as ex, positions, reports, sets, verification as check
from noticeflow.session import checkpointed
from noticeflow.spec import EXTRACTION

from .tables import NOTICES_SQL, notices, slots, sql_normalise, table

ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
WORD = r"\bw[a-vx-z]+"


def _slots_up_to(spark, sf_dir, size):
    lines = table(spark, sf_dir, "lineitem")
    counted = lines.groupBy("l_orderkey").agg(size.alias("n"))
    return counted.select("l_orderkey", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("slot"))


def _actual(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("slot"))


def missing_ids(spark, sf_dir):
    expected = _slots_up_to(spark, sf_dir, F.max("l_linenumber"))
    return sets.missing_ids(expected, _actual(spark, sf_dir), ["l_orderkey"], "slot")


def unexpected_ids(spark, sf_dir):
    expected = _slots_up_to(spark, sf_dir, F.countDistinct("l_linenumber"))
    return sets.unexpected_ids(expected, _actual(spark, sf_dir), ["l_orderkey"], "slot")


def declared_count(spark, sf_dir):
    declared = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.nullif(F.max("l_linenumber"), F.lit(7)).alias("declared")
    )
    return sets.declared_count(_actual(spark, sf_dir), declared, "l_orderkey", "slot", "declared")


def ground_excerpt(spark, sf_dir):
    """Benchmark passages in any document."""
    quotes = table(spark, sf_dir, "benchmark")
    grounded = excerpts.ground_excerpt(quotes, "text", table(spark, sf_dir, "documents"), "doc_id", "text")
    return grounded.select("item_id", "too_short", "found", "texts", "first_text")


def ground_items(spark, sf_dir):
    """A passage of each document, the same in capitals and a short one, checked against the document."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    item = F.struct(F.concat(F.lit("ECR-"), "doc_id").alias("id"), F.substring("text", 30, 70).alias("detail"))
    upper = F.struct(F.lit("ECR-x").alias("id"), F.upper(F.substring("text", 30, 70)).alias("detail"))
    short = F.struct(F.lit("ECR-y").alias("id"), F.substring("text", 1, 20).alias("detail"))
    messages = check.detail_errors(F.array(item, upper, short), F.col("text"))
    return texts.select("doc_id", F.array_join(messages, "; ").alias("errors"))


def verify_extraction(spark, sf_dir):
    """Per notice: a result whose ids, total and quotes are right or wrong by its key."""
    k = F.col("number")
    identifier = lambda n: F.lit(f"ECR–00{n}")
    detail = lambda n: F.concat(F.lit(f"detail {n} of "), "title", F.lit(" for "), "institution", F.lit(" with enough text to check"))
    expected = F.slice(F.array(identifier(1), identifier(2), identifier(3)), F.lit(1), (1 + k % 3).cast("int"))
    item = lambda n, quote: F.struct(identifier(n).alias("id"), quote.alias("detail"))
    second = F.when(k % 5 == 0, F.lit("short")).when(k % 7 == 0, F.upper(detail(2))).otherwise(F.concat(F.lit("  "), F.replace(detail(2), F.lit(" "), F.lit("\n "))))
    items = F.slice(F.array(item(1, detail(1)), item(2, second)), F.lit(1), (1 + k % 2).cast("int"))
    declared = F.when(k % 4 == 0, F.lit(None).cast("int")).otherwise((1 + k % 3 + F.when(k % 11 == 0, 1).otherwise(0)).cast("int"))
    markdown = F.concat(F.lit("ECR–001 ECR-002 "), detail(1), F.lit("\n"), detail(2))
    result = notices(spark, sf_dir).select("number", check.verification(expected, declared, items, markdown).alias("v"))
    joined = lambda field: F.array_join(f"v.{field}", " / ")
    return result.select(
        "number", "v.verified", joined("errors").alias("errors"), joined("warnings").alias("warnings"),
        joined("missing").alias("missing"),
    )


def chunk_ids(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("source", "doc_id")
    chunks = positions.chunk_ids(documents, ["source"], ["doc_id"], "doc_id", 15)
    return chunks.select("source", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


def plan_requests(spark, sf_dir):
    found = F.array_sort(ids.extract_ids("text", WORD))
    documents = table(spark, sf_dir, "documents").withColumn("ids", found)
    return _digests(ex.plan_requests(documents, ["doc_id"], "text", "ids", trim=True))


def plan_whole_requests(spark, sf_dir):
    found = F.array_sort(ids.extract_ids("text", WORD))
    documents = table(spark, sf_dir, "documents").withColumn("ids", found)
    return _digests(ex.plan_requests(documents, ["doc_id"], "text", "ids"))


def _digests(requests):
    return requests.select(
        "doc_id", "request", "kind", F.array_join("ids", " ").alias("ids"), F.md5("source").alias("digest")
    )


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def choose_expected(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return ex.choose_expected(turns.where("role = 'user'"), turns.where("role <> 'user'"), ["conv_id"], "turn")


def merge_responses(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumn("chars", F.length("text"))
    roles = F.explode(F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))).alias("role")
    expected = turns.select("conv_id").distinct().select("conv_id", roles)
    return ex.merge_responses(turns.select("conv_id", "role", "turn", "chars"), expected, ["conv_id"], "role", ["turn"])


def retry_missing(spark, sf_dir):
    """Words of each document that no answer named, as the requests of the next round."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = documents.select("doc_id", F.explode(ids.extract_ids("text", WORD)).alias("id"))
    answered = words.where(F.length("id") > 6)
    requests = ex.retry_missing(documents, words, answered, ["doc_id"], "id", attempt=1, size=10, trim=True)
    return requests.select("doc_id", "request", F.array_join("ids", " ").alias("ids"), F.md5("source").alias("digest"))


def _expected_lines(spark, sf_dir):
    """Lines as expected ids of their orders; the number of the part decides in which round one is answered."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("id")).agg(
        (F.max("l_partkey") % 6).alias("due")
    )


def _line_rounds(spark, sf_dir):
    expected = checkpointed(_expected_lines(spark, sf_dir))
    documents = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("text")
    )

    def ask(requests, attempt):
        asked = requests.select("l_orderkey", F.explode("ids").alias("id"), F.length("source").alias("chars"))
        return asked.join(expected, ["l_orderkey", "id"]).where(F.col("due") <= attempt).drop("due")

    return ex.answer_rounds(documents, expected, ask, ["l_orderkey"], "id", size=3)


def retry_rounds(spark, sf_dir):
    """Ids that no round answered."""
    _, _, missing = _line_rounds(spark, sf_dir)
    return missing


def retry_ledger(spark, sf_dir):
    """Per id the rounds in which it was asked for, and the characters of the text that came with its answer."""
    answers, ledger, _ = _line_rounds(spark, sf_dir)
    asked = ledger.groupBy("l_orderkey", "id").agg(F.count("*").alias("rounds"))
    return asked.join(answers.select("l_orderkey", "id", "chars"), ["l_orderkey", "id"], "left")


def usage_rollup(spark, sf_dir):
    calls = _turns(spark, sf_dir).select("conv_id", F.length("text").cast("long").alias("chars"), "turn")
    return ex.usage_rollup(calls, ["conv_id"], ["chars", "turn"])


def items(spark, sf_dir):
    """Lines as requirement items with nested specifications."""
    spec = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("quantity"))
    quantity = F.when(F.col("l_quantity") % 2 == 0, F.floor("l_quantity").cast("string")).otherwise("")
    size = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string"))
    return slots(spark, sf_dir).select(
        F.col("l_orderkey").alias("number"),
        *ITEM_ORDER,
        F.concat(F.lit("ECR-"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")).alias("id"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("name"),
        F.array(spec("quantity", quantity), spec("size", size)).alias("specs"),
        F.when(F.col("l_returnflag") == "R", F.array("p_brand", F.lit("report"))).otherwise(F.array().cast("array<string>")).alias("deliverables"),
        F.concat_ws(" ", "p_brand", "p_type").alias("detail"),
        F.when(F.col("l_linestatus") == "O", F.array(F.lit("size unclear"), "l_linestatus")).otherwise(F.array().cast("array<string>")).alias("doubts"),
        (F.col("l_returnflag") != "N").alias("verified"),
    )


def export_items(spark, sf_dir):
    found = notices(spark, sf_dir).where("mode = 'bid'").select("number", "title")
    return reports.export_requirements(found, items(spark, sf_dir), ["number"])


def requirement_report(spark, sf_dir):
    return reports.requirement_report(items(spark, sf_dir), ["number", *ITEM_ORDER])


def explode_specs(spark, sf_dir):
    return reports.explode_specs(items(spark, sf_dir), ["number", *ITEM_ORDER, "id"])


def build_items(spark, sf_dir):
    """Lines of an order as arrays of at most three items, read back in order."""
    rows = items(spark, sf_dir).select("number", *ITEM_ORDER, "id", "name")
    built = ex.build_items(rows, ["number"], ITEM_ORDER, ["id", "name"], part_size=3)
    shown = F.transform("items", lambda i: F.concat_ws(":", i["id"], i["name"]))
    return built.select("number", "part", F.array_join(shown, ";").alias("items"))


def explode_items(spark, sf_dir):
    """Words of the documents as items; documents without any stay."""
    words = F.transform(ids.extract_ids("text", WORD), lambda w: F.struct(w.alias("word"), F.length(w).alias("chars")))
    documents = table(spark, sf_dir, "documents").select("doc_id", words.alias("items"))
    return ex.explode_items(documents).select("doc_id", "word", "chars")


def collect_alerts(spark, sf_dir):
    k = F.col("number")
    missing = F.slice(F.array(F.lit("ECR-1"), F.lit("ECR-2")), F.lit(1), (k % 3).cast("int"))
    errors = F.filter(F.array(F.when(k % 2 == 0, F.col("business_type"))), lambda e: e.isNotNull())
    made = F.array(
        F.struct(F.lit("ECR-3").alias("id"), F.split("title", " ").alias("doubts")),
        F.struct(F.lit("ECR-4").alias("id"), F.array().cast("array<string>").alias("doubts")),
    )
    return reports.collect_alerts(notices(spark, sf_dir), ["number"], reports.item_alerts(missing, errors, made))


def analysis_summary(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("verified"))
    results = documents.join(labels, "doc_id").select(
        "doc_id", "verified", F.concat_ws("-", "lang", "source").alias("analysed_at"), ids.extract_ids("text", WORD).alias("items")
    )
    return reports.analysis_summary(results, "items", "analysed_at")


def _answers(spark, sf_dir):
    """Notices as answers in JSON, in three spellings; every fifth lacks a key, some are broken."""
    k = F.col("number")
    item = F.concat(F.lit('{"reqNo":"ECR-'), k, F.lit('","name":"'), "title", F.lit('","detail":"d","basicSpecs":[{"item":"cpu","quantity":'), k % 9, F.lit('}],"derivedSpecs":{"other":"x"},"uncertainties":["u"]}'))
    loose = F.concat(F.lit('{"requirementsList":[{"category":"c","requirementId":"ECR-'), k, F.lit('","title":"t"}],"requirementCount":'), k % 4, F.lit(',"ecrDetails":['), item, F.lit('],"requirementIdRule":"r","missing":["m"]}'))
    strict = F.concat(
        F.lit('{"사업개요":{"사업명":"a","수요기관":"b","사업기간":"","예산":"","계약방식":""},"ID부여규칙":"r","요구사항수":'),
        F.when(k % 2 == 0, F.lit("null")).otherwise((k % 4).cast("string")),
        F.lit(',"요구사항목록":[{"구분":"c","ID":"ECR-'), k, F.lit('","명칭":"t"}],"ecr":[],"누락":[]'),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(',"기타요구사항":[]')), F.when(k % 7 == 0, F.lit(',"extra":1')).otherwise(F.lit("")), F.lit("}"),
    )
    raw = F.when(k % 3 == 0, strict).when(k % 3 == 1, loose).otherwise(F.lit("{broken"))
    return notices(spark, sf_dir).select("number", "title", raw.alias("raw"))


def normalise_keys(spark, sf_dir):
    parsed = _answers(spark, sf_dir).select("number", ex.normalise_keys("raw").alias("r"))
    first = F.try_element_at("r.ecr", F.lit(1))
    spec = F.try_element_at(first["기본규격"], F.lit(1))
    return parsed.select(
        "number", F.col("r.사업개요")["사업명"].alias("project"), F.col("r.요구사항수").alias("declared"),
        F.try_element_at("r.요구사항목록", F.lit(1))["ID"].alias("listed"), first["id"].alias("id"), first["명칭"].alias("name"),
        first["세부내용_원문"].alias("detail"), spec["수량"].alias("quantity"), first["파생규격"]["기타"].alias("other"),
        F.array_join(first["불확실"], ",").alias("doubts"), F.array_join("r.누락", ",").alias("missing"),
    )


def conforms(spark, sf_dir):
    return _answers(spark, sf_dir).select("number", ex.conforms("raw", EXTRACTION).alias("conforms"))


_WORDS = r"list_sort(list_distinct(regexp_extract_all(text, '\bw[a-vx-z]+')))"


def _window_sql(source, word):
    at = f"(length({source}) - length(list_extract(string_split({source}, {word}), -1)) - length({word}))"
    return f"""substring({source}, greatest({at} - 220, 0) + 1,
      least({at} + 1350, length({source})) - greatest({at} - 220, 0))"""


_ITEMS_SQL = """SELECT l_orderkey AS number, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  'ECR-' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS id, p_type AS category, p_name AS name,
  CASE WHEN l_quantity % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '' END AS q,
  CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS s,
  CASE WHEN l_returnflag = 'R' THEN p_brand || ', report' ELSE '' END AS deliverables,
  p_brand || ' ' || p_type AS detail, l_linestatus = 'O' AS doubted,
  CASE WHEN l_returnflag <> 'N' THEN '통과' ELSE '원문 확인 필요' END AS status
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
_QUANTITIES = "q || CASE WHEN q <> '' AND s <> '' THEN ', ' ELSE '' END || s"

_LINES_SQL = """WITH e AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS id, max(l_partkey) % 6 AS due FROM lineitem GROUP BY 1, 2)"""

QUERIES = {
    "retry_rounds": (retry_rounds, f"{_LINES_SQL} SELECT l_orderkey, id FROM e WHERE due > 3"),
    "retry_ledger": (
        retry_ledger,
        f"""{_LINES_SQL} SELECT l_orderkey, id, least(due, 3) + 1 AS rounds,
          CASE WHEN due <= 3 THEN CAST(length(o_orderpriority || ' ' || o_orderkey) AS INTEGER) END AS chars
        FROM e JOIN orders ON o_orderkey = l_orderkey""",
    ),
    "missing_ids": (
        missing_ids,
        """WITH m AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
        SELECT l_orderkey, CAST(i AS INTEGER) AS slot FROM m, range(1, 8) r(i) WHERE i <= n
          AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = m.l_orderkey AND x.l_linenumber = i)""",
    ),
    "unexpected_ids": (
        unexpected_ids,
        """WITH m AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
        SELECT DISTINCT l.l_orderkey, l_linenumber AS slot FROM lineitem l JOIN m ON l.l_orderkey = m.l_orderkey
        WHERE l_linenumber > n""",
    ),
    "declared_count": (
        declared_count,
        """SELECT l_orderkey, nullif(max(l_linenumber), 7) AS declared, count(DISTINCT l_linenumber) AS listed,
          coalesce(nullif(max(l_linenumber), 7) = count(DISTINCT l_linenumber), TRUE) AS agrees FROM lineitem GROUP BY 1""",
    ),
    "ground_excerpt": (
        ground_excerpt,
        f"""WITH q AS (SELECT item_id, left({sql_normalise('text')}, 40) AS e FROM benchmark),
        d AS (SELECT doc_id, {sql_normalise('text')} AS t FROM documents)
        SELECT item_id, length(e) < 40 AS too_short, count(doc_id) > 0 AS found, count(doc_id) AS texts, min(doc_id) AS first_text
        FROM q LEFT JOIN d ON length(e) = 40 AND instr(t, e) > 0 GROUP BY item_id, e""",
    ),
    "ground_items": (
        ground_items,
        f"""WITH d AS (SELECT doc_id, {sql_normalise('text')} AS t, left({sql_normalise('substring(text, 30, 70)')}, 40) AS e,
            left({sql_normalise('upper(substring(text, 30, 70))')}, 40) AS u FROM documents),
        m AS (SELECT doc_id, [
          CASE WHEN length(e) < 40 THEN 'ECR-' || doc_id || ': 세부내용_원문이 너무 짧음'
               WHEN instr(t, e) = 0 THEN 'ECR-' || doc_id || ': 세부내용_원문이 변환 Markdown에서 확인되지 않음' END,
          CASE WHEN length(u) < 40 THEN 'ECR-x: 세부내용_원문이 너무 짧음'
               WHEN instr(t, u) = 0 THEN 'ECR-x: 세부내용_원문이 변환 Markdown에서 확인되지 않음' END,
          'ECR-y: 세부내용_원문이 너무 짧음'] AS l FROM d)
        SELECT doc_id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), '; ') AS errors FROM m""",
    ),
    "verify_extraction": (
        verify_extraction,
        f"""WITH n AS (SELECT number, number % 3 AS e, number % 2 AS i, number % 4 = 0 AS undeclared, number % 11 = 0 AS off,
            number % 5 = 0 AS short, number % 7 = 0 AS wrong FROM ({NOTICES_SQL})),
        m AS (SELECT number, list_filter([
          CASE WHEN e = 2 AND i = 1 THEN '상세 추출 누락: ECR–003' WHEN e = 2 THEN '상세 추출 누락: ECR–002, ECR–003'
               WHEN e = 1 AND i = 0 THEN '상세 추출 누락: ECR–002' END,
          CASE WHEN e = 0 AND i = 1 THEN '총괄표에 없는 ECR: ECR–002' END,
          CASE WHEN NOT undeclared AND off THEN '총괄표 ECR 수 불일치: 선언 ' || (e + 2) || ', 목록 ' || (e + 1) END,
          CASE WHEN i = 1 AND short THEN 'ECR–002: 세부내용_원문이 너무 짧음'
               WHEN i = 1 AND wrong THEN 'ECR–002: 세부내용_원문이 변환 Markdown에서 확인되지 않음' END],
          lambda x: x IS NOT NULL) AS l, e, i FROM n)
        SELECT number, len(l) = 0 AS verified, coalesce(array_to_string(l, ' / '), '') AS errors,
          CASE WHEN e = 2 THEN '변환 텍스트에서 확인되지 않은 ID(경고): ECR-003' ELSE '' END AS warnings,
          CASE WHEN e = 2 AND i = 1 THEN 'ECR–003' WHEN e = 2 THEN 'ECR–002 / ECR–003' WHEN e = 1 AND i = 0 THEN 'ECR–002' ELSE '' END AS missing
        FROM m""",
    ),
    "chunk_ids": (
        chunk_ids,
        """WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)
        SELECT source, n // 15 AS chunk, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) AS ids FROM p GROUP BY 1, 2""",
    ),
    "plan_requests": (
        plan_requests,
        f"""WITH w AS (SELECT doc_id, text, {_WORDS} AS l FROM documents),
        c AS (SELECT doc_id, text, l, unnest(range(0, len(l), 15)) AS s FROM w),
        r AS (SELECT doc_id, CAST(s // 15 + 1 AS INTEGER) AS request, s, text, l[s + 1 : s + 15] AS l FROM c),
        x AS (SELECT doc_id, request, l, unnest(l) AS word, generate_subscripts(l, 1) AS i, text FROM r)
        SELECT doc_id, 0 AS request, 'summary' AS kind, '' AS ids, md5(left(text, 6200)) AS digest FROM documents
        UNION ALL
        SELECT doc_id, request, 'details', string_agg(word, ' ' ORDER BY i),
          md5(string_agg({_window_sql('text', 'word')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i))
        FROM x GROUP BY doc_id, request""",
    ),
    "plan_whole_requests": (
        plan_whole_requests,
        f"""WITH w AS (SELECT doc_id, text, {_WORDS} AS l FROM documents),
        c AS (SELECT doc_id, text, l, unnest(range(0, len(l), 15)) AS s FROM w)
        SELECT doc_id, 0 AS request, 'summary' AS kind, '' AS ids, md5(text) AS digest FROM documents
        UNION ALL
        SELECT doc_id, CAST(s // 15 + 1 AS INTEGER), 'details', array_to_string(l[s + 1 : s + 15], ' '), md5(text) FROM c""",
    ),
    "choose_expected": (
        choose_expected,
        """WITH s AS (SELECT conv_id, count(DISTINCT turn) FILTER (role = 'user') AS d,
            count(DISTINCT turn) FILTER (role <> 'user') AS f FROM conversations GROUP BY 1)
        SELECT DISTINCT c.conv_id, CASE WHEN f > d THEN 'found' ELSE 'declared' END AS origin, turn, greatest(f, d) AS expected
        FROM conversations c JOIN s ON c.conv_id = s.conv_id WHERE (role <> 'user') = (f > d)""",
    ),
    "merge_responses": (
        merge_responses,
        """WITH e AS (SELECT DISTINCT conv_id, role FROM conversations, (VALUES ('user'), ('assistant'), ('system')) v(r),
            LATERAL (SELECT r AS role) x),
        l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1),
        k AS (SELECT DISTINCT c.conv_id, r AS role FROM conversations c, (VALUES ('user'), ('assistant'), ('system')) v(r))
        SELECT k.conv_id, k.role, l.turn, CAST(length(l.text) AS INTEGER) AS chars, l.conv_id IS NULL AS missing
        FROM k LEFT JOIN l ON k.conv_id = l.conv_id AND k.role = l.role""",
    ),
    "retry_missing": (
        retry_missing,
        f"""WITH w AS (SELECT doc_id, text, list_filter({_WORDS}, lambda x: length(x) <= 6) AS l FROM documents),
        x AS (SELECT doc_id, text, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM w)
        SELECT doc_id, i // 10 AS request, string_agg(word, ' ' ORDER BY i) AS ids,
          md5(string_agg({_window_sql('text', 'word')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i)) AS digest
        FROM x GROUP BY 1, 2""",
    ),
    "usage_rollup": (
        usage_rollup,
        """SELECT conv_id, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(turn) AS BIGINT) AS turn
        FROM conversations GROUP BY 1""",
    ),
    "export_items": (
        export_items,
        f"""SELECT i.number, title, id, category, name, {_QUANTITIES} AS quantities, deliverables, detail, status
        FROM ({_ITEMS_SQL}) i JOIN ({NOTICES_SQL}) n ON i.number = n.number WHERE mode = 'bid'""",
    ),
    "requirement_report": (
        requirement_report,
        f"""SELECT number, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, id, category, name,
          coalesce(nullif({_QUANTITIES}, ''), '-') AS quantities, coalesce(nullif(deliverables, ''), '-') AS deliverables,
          2 AS spec_rows, CASE WHEN doubted THEN id || ': size unclear' || chr(10) || id || ': O' ELSE '' END AS alerts, status
        FROM ({_ITEMS_SQL})""",
    ),
    "explode_specs": (
        explode_specs,
        f"""WITH i AS ({_ITEMS_SQL}), k AS (SELECT number, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, id, q, s FROM i)
        SELECT * EXCLUDE (q, s), 0 AS spec_ix, 'quantity' AS field, q AS quantity FROM k
        UNION ALL SELECT * EXCLUDE (q, s), 1, 'size', nullif(s, '') FROM k""",
    ),
    "build_items": (
        build_items,
        f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY {', '.join(ITEM_ORDER)}) - 1 AS n FROM ({_ITEMS_SQL}))
        SELECT number, n // 3 AS part, string_agg(id || ':' || name, ';' ORDER BY n) AS items FROM p GROUP BY 1, 2""",
    ),
    "explode_items": (
        explode_items,
        f"""SELECT doc_id, word, CAST(length(word) AS INTEGER) AS chars FROM (
          SELECT doc_id, unnest(CASE WHEN len({_WORDS}) = 0 THEN [NULL] ELSE {_WORDS} END) AS word FROM documents)""",
    ),
    "collect_alerts": (
        collect_alerts,
        f"""WITH a AS (SELECT number, list_concat(list_concat(
            CASE number % 3 WHEN 0 THEN [] WHEN 1 THEN ['누락: ECR-1'] ELSE ['누락: ECR-1', '누락: ECR-2'] END,
            CASE WHEN number % 2 = 0 THEN [business_type] ELSE [] END),
            list_transform(string_split(title, ' '), lambda w: 'ECR-3: ' || w)) AS l FROM ({NOTICES_SQL}))
        SELECT number, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS alert FROM a""",
    ),
    "analysis_summary": (
        analysis_summary,
        f"""SELECT d.doc_id, quality = 1 AS verified, lang || '-' || source AS analysed_at, CAST(len({_WORDS}) AS INTEGER) AS item_count
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "normalise_keys": (
        normalise_keys,
        f"""SELECT number, CASE number % 3 WHEN 0 THEN 'a' WHEN 1 THEN '' END AS project,
          CASE WHEN number % 3 = 0 AND number % 2 = 0 THEN NULL WHEN number % 3 < 2 THEN CAST(number % 4 AS INTEGER) END AS declared,
          CASE WHEN number % 3 < 2 THEN 'ECR-' || number END AS listed,
          CASE WHEN number % 3 = 1 THEN 'ECR-' || number END AS id, CASE WHEN number % 3 = 1 THEN title END AS name,
          CASE WHEN number % 3 = 1 THEN 'd' END AS detail, CASE WHEN number % 3 = 1 THEN CAST(number % 9 AS VARCHAR) END AS quantity,
          CASE WHEN number % 3 = 1 THEN 'x' END AS other, CASE WHEN number % 3 = 1 THEN 'u' END AS doubts,
          CASE number % 3 WHEN 0 THEN '' WHEN 1 THEN 'm' END AS missing FROM ({NOTICES_SQL})""",
    ),
    "conforms": (
        conforms,
        f"SELECT number, number % 3 = 0 AND number % 5 <> 0 AND number % 7 <> 0 AS conforms FROM ({NOTICES_SQL})",
    ),
}
