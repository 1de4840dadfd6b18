"""Request planning and landed responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.operators import extraction
from noticeflow.plans import jobs
from noticeflow.sources import envelope, landed, paged_rest

from .tables import table


def parse_envelope(spark, sf_dir):
    """Orders as items, in responses of the four shapes."""
    k = F.col("o_orderkey")
    item = lambda n: F.concat(
        F.lit('{"no":"'), k, F.lit(f'-{n}","nested":{{"a":{n}}},"none":null,"count":'), k % 100, F.lit("}")
    )
    two = F.concat(F.lit("["), item(1), F.lit(","), item(2), F.lit("]"))
    items = (
        F.when(k % 4 == 0, two)
        .when(k % 4 == 1, F.concat(F.lit('{"item":'), two, F.lit("}")))
        .when(k % 4 == 2, F.concat(F.lit('{"item":'), item(1), F.lit("}")))
        .otherwise(F.lit("null"))
    )
    body = F.concat(F.lit('{"response":{"header":{},"body":{"totalCount":"'), k, F.lit('","numOfRows":"10","items":'), items, F.lit("}}}"))
    responses = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    totals = responses.withColumn("totals", envelope.envelope_totals(F.col("body")))
    read = lambda name: F.try_element_at("item", F.lit(name))
    return envelope.parse_envelope(totals).select(
        "o_orderkey", "item_ix", read("no").alias("no"), read("nested").alias("nested"),
        read("count").alias("count"), F.col("totals.total").alias("total"),
        jobs.page_count(F.col("totals.total"), F.col("totals.page_size")).alias("pages"),
    )


def classify_events(spark, sf_dir):
    k = extraction.pick_number("props", ["k"])
    events = table(spark, sf_dir, "events").withColumn("k", k)
    k = F.col("k")
    status = F.when(k % 7 == 0, 429).when(F.col("event_type") == "error", 500 + k % 4).otherwise(200)
    body = (
        F.when(k % 13 == 0, F.lit("<xml>PERIOD</xml>"))
        .when(k % 10 == 0, F.lit('{"response":{"header":{"resultMsg":"PERIOD too long"}}}'))
        .when(k % 10 == 5, F.lit('{"response":{"header":{"resultMsg":"denied"}}}'))
        .when(k % 10 == 6, F.lit('{"error":"gateway","upstreamStatus":504}'))
        .otherwise(F.lit(' {"response":{"body":{"items":[]}}}'))
    )
    classed = events.withColumn("class", envelope.classify(status, body))
    return classed.groupBy("event_type", "class").agg(F.count(F.lit(1)).alias("responses"))


def _order_bounds(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.agg(
        F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day")
    )


def _chunks(spark, sf_dir, days):
    return jobs.chunk_ranges(_order_bounds(spark, sf_dir), "first_day", "last_day", days).drop("last_day")


def _chunk_counts(spark, sf_dir, days):
    """Orders per chunk of days."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    # the bounds are one row
    placed = orders.crossJoin(F.broadcast(_order_bounds(spark, sf_dir)))
    counted = placed.groupBy(F.floor(F.datediff("day", "first_day") / days).cast("int").alias("chunk")).agg(
        F.count(F.lit(1)).alias("total")
    )
    chunks = _chunks(spark, sf_dir, days).drop("first_day")
    return chunks.join(counted, "chunk", "left").fillna(0, ["total"])


def date_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, 28).drop("first_day")


def plan_pages(spark, sf_dir):
    return jobs.plan_pages(_chunk_counts(spark, sf_dir, 28), "total", 100)


def plan_jobs(spark, sf_dir):
    institutions = table(spark, sf_dir, "nation").select(F.col("n_name").alias("institution"))
    types = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("business_type")).distinct()
    return jobs.plan_jobs(institutions, types, date_chunks(spark, sf_dir))


def split_chunk(spark, sf_dir):
    """30-day chunks with more orders than the mean fail once."""
    counts = _chunk_counts(spark, sf_dir, 30)
    mean = counts.select(F.avg("total")).scalar()
    return jobs.split_ranges(counts.withColumn("depth", F.lit(0)), F.col("total") > mean)


def _read_orders(spark, sf_dir):
    """Reads orders of ranges; one with more than ``limit`` orders fails and brings those of its first half."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("day"), "o_orderkey"
    )

    def read(pending):
        ranges = pending.select("*", F.explode(F.sequence("chunk_begin", "chunk_end")).alias("day"))
        found = ranges.join(orders, ["kind", "day"], "left")
        totals = found.groupBy(*pending.columns).agg(F.count("o_orderkey").alias("total"))
        status = F.when(F.col("total") <= F.col("limit"), "ok").when(F.col("total") % 2 == 0, "transient").otherwise("range_error")
        judged = totals.withColumn("status", status).withColumn("error", F.when(F.col("status") != "ok", F.concat_ws(" ", "status", "total")))
        half = F.date_add("chunk_begin", F.floor(F.datediff("chunk_end", "chunk_begin") / 2).cast("int"))
        rows = found.join(judged, pending.columns).where((F.col("status") == "ok") | (F.col("day") <= half))
        return rows.drop("total")

    return read


def _order_plan(spark, sf_dir):
    """Chunks of 30 days for each priority; a range may hold four times the mean orders of a day."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"), "o_orderpriority").agg(F.count("*").alias("n"))
    limit = days.agg(F.ceil(4 * F.avg("n")).alias("limit"))
    kinds = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind")).distinct()
    # chunks, priorities and the limit are a plan, not data
    return _chunks(spark, sf_dir, 30).drop("first_day").crossJoin(kinds).crossJoin(F.broadcast(limit))


def adaptive_ranges(spark, sf_dir):
    """What each range landed in the end, several splits deep."""
    landed, _, _ = jobs.read_adaptive(_order_plan(spark, sf_dir), _read_orders(spark, sf_dir), ["kind"])
    return landed.groupBy("kind", "chunk_begin", "chunk_end", "depth", "status").agg(
        F.count("o_orderkey").alias("orders"), F.coalesce(F.sum("o_orderkey"), F.lit(0).cast("long")).alias("keys")
    )


def adaptive_outcomes(spark, sf_dir):
    """Pieces and first error of each planned range, with the span learned for its priority."""
    _, outcome, learned = jobs.read_adaptive(_order_plan(spark, sf_dir), _read_orders(spark, sf_dir), ["kind"])
    return outcome.join(learned, "kind", "left").select("kind", "root_begin", "pieces", "error", "learned_days")


PAGE = 40


def _order_pages(job, page):
    """Pages with as many items as a customer segment and status have orders. Some jobs break on their second page."""
    total, kind = job["orders"], job["kind"]
    if page == 2 and kind == 1:
        return 200, "[]"
    first = (page - 1) * PAGE
    items = ",".join(f'{{"no":{i}}}' for i in range(first, min(first + PAGE, total)))
    count = '"n/a"' if page == 2 and kind == 2 else total
    return 200, f'{{"response":{{"body":{{"items":[{items}],"totalCount":{count},"numOfRows":"{PAGE}"}}}}}}'


def paged_jobs(spark, sf_dir):
    """Items and errors of jobs read page by page; of those that fail nothing but the error is kept."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sizes = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("c_mktsegment", "o_orderstatus").count()
    # five segments and three statuses are a plan, not data
    plan = sizes.orderBy("c_mktsegment", "o_orderstatus").collect()
    jobs = [{"segment": s, "status": o, "orders": n, "kind": n % 3 if n > PAGE else 0} for s, o, n in plan]
    spark.dataSource.register(paged_rest.paged_rest_source(_order_pages, "order_pages"))
    landed = paged_rest.read_jobs(spark, jobs, keep_partial=False, source="order_pages")
    number = F.try_element_at("item", F.lit("no")).cast("long")
    segment = F.get_json_object("job_id", "$.segment")
    return landed.groupBy(segment.alias("segment"), F.get_json_object("job_id", "$.status").alias("status")).agg(
        F.count("item").alias("items"), F.coalesce(F.sum(number), F.lit(0).cast("long")).alias("numbers"),
        F.coalesce(F.max("page"), F.lit(0)).alias("pages"), F.max("error").alias("error"),
    )


def resume_pending(spark, sf_dir):
    plan = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type").distinct()
    return jobs.resume_pending(plan, plan.where("day < date '2024-01-15'"), ["day", "event_type"])


def split_dead_letter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    tagged = landed.tag_failures(events, F.col("event_type") == "error", F.concat(F.lit("value "), F.floor("value")))
    good, failed = landed.split_dead_letter(tagged)
    return good.withColumn("reason", F.lit("-")).unionByName(failed)


def page_fetch_check(spark, sf_dir):
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    status = F.when(k % 7 == 0, 404).otherwise(200)
    content_type = F.when(F.col("url").contains("?"), F.lit("Text/HTML; charset=utf-8")).otherwise("application/pdf")
    length = F.when(k % 5 == 0, 0).otherwise(F.length("html"))
    wanted = pages.select("page_id", F.col("url").alias("target"), landed.fetch_check(status, content_type, length).alias("reason"))
    existing = pages.where("url like 'https://www.%'").select(F.col("url").alias("target"), F.when(k % 2 == 0, 0).otherwise(1).alias("length"))
    return landed.to_fetch(wanted, existing).select("page_id", "reason")


def normalise_props(spark, sf_dir):
    """Numbers under either of two names, or absent."""
    k = F.col("event_id")
    props = F.when(k % 3 == 1, F.replace("props", F.lit('"k"'), F.lit('"key"'))).when(k % 3 == 2, F.lit("{}")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", extraction.pick_number(props, ["k", "key"]).alias("k"))


_BOUNDS = "b AS (SELECT CAST(min(o_orderdate) AS DATE) AS f, CAST(max(o_orderdate) AS DATE) AS l FROM orders)"


def _chunks_sql(days):
    return f"""{_BOUNDS}, c AS (
      SELECT CAST(i AS INTEGER) AS chunk, f + CAST(i * {days} AS INTEGER) AS chunk_begin,
        least(f + CAST(i * {days} + {days - 1} AS INTEGER), l) AS chunk_end
      FROM b, range(2000) r(i) WHERE f + CAST(i * {days} AS INTEGER) <= l),
    t AS (SELECT chunk, chunk_begin, chunk_end, count(o_orderkey) AS total FROM c LEFT JOIN orders
      ON CAST(o_orderdate AS DATE) BETWEEN chunk_begin AND chunk_end GROUP BY ALL)"""


# Ranges split round by round; totals of a range from running counts.
_ADAPTIVE_SQL = f"""
  WITH RECURSIVE {_chunks_sql(30)},
  k AS (SELECT DISTINCT o_orderpriority AS kind FROM orders),
  n AS (SELECT o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(o_orderkey) AS s FROM orders GROUP BY 1, 2),
  lim AS (SELECT ceil(4 * avg(n)) AS l FROM n),
  grid AS (SELECT kind, f + CAST(i AS INTEGER) AS day FROM k, b, range(0, 4000) r(i) WHERE f + CAST(i AS INTEGER) <= l),
  u AS (SELECT kind, day, sum(coalesce(n, 0)) OVER w AS c, sum(coalesce(s, 0)) OVER w AS s
    FROM grid LEFT JOIN n USING (kind, day) WINDOW w AS (PARTITION BY kind ORDER BY day)),
  r AS (
    SELECT kind, chunk_begin AS root, chunk_begin AS cb, chunk_end AS ce, 0 AS depth,
      e.c - coalesce(a.c, 0) AS total, e.s - coalesce(a.s, 0) AS keys
    FROM c, k JOIN u e USING (kind) LEFT JOIN u a ON a.kind = e.kind AND a.day = chunk_begin - 1 WHERE e.day = chunk_end
    UNION ALL
    SELECT p.kind, root, nb, ne, depth + 1, e.c - coalesce(a.c, 0), e.s - coalesce(a.s, 0)
    FROM (SELECT *, unnest([cb, cb + lefts]) AS nb, unnest([cb + lefts - 1, ce]) AS ne
          FROM (SELECT *, CASE WHEN ce - cb + 1 > 28 THEN 28 ELSE CAST((ce - cb + 1) // 2 AS INTEGER) END AS lefts
                FROM r, lim WHERE total > l AND ce > cb AND depth < 6)) p
    JOIN u e ON e.kind = p.kind AND e.day = ne LEFT JOIN u a ON a.kind = p.kind AND a.day = nb - 1),
  z AS (SELECT r.*, total > l AS bad, total > l AND ce > cb AND depth < 6 AS split,
      CASE WHEN total <= l THEN 'ok' WHEN total % 2 = 0 THEN 'transient' ELSE 'range_error' END AS status,
      CASE WHEN ce - cb + 1 > 28 THEN 28 ELSE CAST((ce - cb + 1) // 2 AS INTEGER) END AS lefts FROM r, lim)
"""

QUERIES = {
    "paged_jobs": (
        paged_jobs,
        f"""WITH s AS (SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
        k AS (SELECT *, CASE WHEN n > {PAGE} THEN n % 3 ELSE 0 END AS kind FROM s)
        SELECT segment, status, CASE WHEN kind = 0 THEN n ELSE 0 END AS items,
          CASE WHEN kind = 0 THEN CAST(n * (n - 1) // 2 AS BIGINT) ELSE 0 END AS numbers,
          CASE WHEN kind = 0 THEN CAST(ceil(n / {PAGE}.0) AS INTEGER) ELSE 0 END AS pages,
          CASE kind WHEN 1 THEN 'the body is no object: []' WHEN 2 THEN 'totalCount is no number: n/a' END AS error FROM k""",
    ),
    "adaptive_ranges": (
        adaptive_ranges,
        # a range that fails for good is a single day, which its first half is
        f"""{_ADAPTIVE_SQL} SELECT kind, cb AS chunk_begin, ce AS chunk_end, depth, status, CAST(total AS BIGINT) AS orders,
          CAST(keys AS BIGINT) AS keys FROM z WHERE NOT split""",
    ),
    "adaptive_outcomes": (
        adaptive_outcomes,
        f"""{_ADAPTIVE_SQL} SELECT kind, root AS root_begin, count(*) AS pieces,
          min_by(status || ' ' || CAST(total AS BIGINT), cb) FILTER (bad) AS error,
          (SELECT min(lefts) FROM z y WHERE split AND y.kind = z.kind) AS learned_days
        FROM z WHERE NOT split GROUP BY kind, root""",
    ),
    "parse_envelope": (
        parse_envelope,
        """WITH i AS (SELECT o_orderkey AS k, n FROM orders, (VALUES (1), (2)) v(n)
          WHERE o_orderkey % 4 IN (0, 1) OR (o_orderkey % 4 = 2 AND n = 1))
        SELECT k AS o_orderkey, n - 1 AS item_ix, k || '-' || n AS no, '{"a":' || n || '}' AS nested,
          CAST(k % 100 AS VARCHAR) AS count, k AS total, CAST(greatest(1, ceil(k / 10.0)) AS INTEGER) AS pages FROM i""",
    ),
    "classify_events": (
        classify_events,
        """WITH e AS (SELECT event_type, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)
        SELECT event_type, CASE WHEN k % 13 = 0 OR k % 7 = 0 OR event_type = 'error' THEN 'transient'
            WHEN k % 10 = 0 THEN 'range_error' WHEN k % 10 = 5 THEN 'error' WHEN k % 10 = 6 THEN 'transient' ELSE 'ok' END AS class,
          count(*) AS responses FROM e GROUP BY ALL""",
    ),
    "date_chunks": (date_chunks, f"WITH {_chunks_sql(28)} SELECT chunk, chunk_begin, chunk_end FROM c"),
    "plan_pages": (
        plan_pages,
        f"""WITH {_chunks_sql(28)} SELECT chunk, chunk_begin, chunk_end, total, CAST(p AS INTEGER) AS page
        FROM t, range(1, 100000) r(p) WHERE p <= greatest(1, ceil(total / 100.0))""",
    ),
    "plan_jobs": (
        plan_jobs,
        f"""WITH {_chunks_sql(28)}, j AS (
          SELECT n_name AS institution, business_type, chunk, chunk_begin, chunk_end
          FROM nation, (SELECT DISTINCT c_mktsegment AS business_type FROM customer), c)
        SELECT *, '{{"institution":"' || institution || '","business_type":"' || business_type || '","chunk":' || chunk
          || ',"chunk_begin":"' || chunk_begin || '","chunk_end":"' || chunk_end || '"}}' AS job_id FROM j""",
    ),
    "split_chunk": (
        split_chunk,
        f"""WITH {_chunks_sql(30)}, s AS (
          SELECT *, total > (SELECT avg(total) FROM t) AND chunk_end > chunk_begin AS split,
            CAST(chunk_end - chunk_begin + 1 AS INTEGER) AS days FROM t),
        h AS (SELECT *, CASE WHEN days > 28 THEN 28 ELSE days // 2 END AS lefts FROM s)
        SELECT chunk, total, chunk_begin, chunk_end, 0 AS depth FROM h WHERE NOT split
        UNION ALL SELECT chunk, total, chunk_begin, chunk_begin + CAST(lefts - 1 AS INTEGER), 1 FROM h WHERE split
        UNION ALL SELECT chunk, total, chunk_begin + CAST(lefts AS INTEGER), chunk_end, 1 FROM h WHERE split""",
    ),
    "resume_pending": (
        resume_pending,
        """SELECT DISTINCT CAST(ts AS DATE) AS day, event_type FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'""",
    ),
    "split_dead_letter": (
        split_dead_letter,
        """SELECT event_id, event_type, value, CASE WHEN event_type = 'error'
          THEN 'value ' || CAST(floor(value) AS BIGINT) ELSE '-' END AS reason FROM events""",
    ),
    "page_fetch_check": (
        page_fetch_check,
        """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'HTTP 404' WHEN instr(url, '?') > 0 THEN 'html'
          WHEN page_id % 5 = 0 OR length(html) = 0 THEN 'empty' END AS reason
        FROM pages WHERE NOT (url LIKE 'https://www.%' AND page_id % 2 = 1)""",
    ),
    "normalise_props": (
        normalise_props,
        """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE CAST(props ->> '$.k' AS BIGINT) END AS k FROM events""",
    ),
}
