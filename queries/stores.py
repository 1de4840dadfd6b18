"""Keyed store, counts, CSV interchange and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.session import work_dir
from noticeflow.sources import daily_csv, store as st
from noticeflow.streaming import streams

from .tables import NOTICES_SQL, notices, table

SPLIT_DAY = "2024-01-20"


def _changes(spark, sf_dir):
    """Events as changes of the notice ``user_id``."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("bid:"), "user_id").alias("key"),
        F.lit("bid").alias("mode"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("event_id").alias("seq"),
        "event_type",
        "value",
    )


def daily_counts(spark, sf_dir):
    found = notices(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return st.daily_counts(found)


def carry_counts(spark, sf_dir):
    events = _changes(spark, sf_dir)
    counts = st.daily_counts(events)
    previous = counts.where(F.col("day") <= SPLIT_DAY)
    current = st.daily_counts(events.where("event_type <> 'view'")).where("day >= '2024-01-15'")
    return st.merge_counts(previous, current)


def upsert_relocate(spark, sf_dir):
    """A store up to one day, then the later changes: keys move to their newest day."""
    store = st.NoticeStore(spark, work_dir(spark, "store"))
    changes = _changes(spark, sf_dir)
    store.upsert(changes.where(F.col("day") <= SPLIT_DAY))
    store.upsert(changes.where(F.col("day") > SPLIT_DAY))
    return store.read().select("key", "day", "seq", "event_type", "value")


def daily_index(spark, sf_dir):
    """Counts of the index after a relocating upsert; emptied days are gone."""
    store = st.NoticeStore(spark, work_dir(spark, "store"))
    changes = _changes(spark, sf_dir)
    store.upsert(changes.where(F.col("day") <= SPLIT_DAY))
    store.upsert(changes.where(F.col("day") > SPLIT_DAY))
    return store.daily_index().select("mode", "date", "count")


def locate_existing(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    stored = changes.where(F.col("day") <= SPLIT_DAY).groupBy("key", "mode").agg(F.max("day").alias("day"))
    later = changes.where(F.col("day") > SPLIT_DAY).select("key", "seq")
    return st.locate_existing(later, stored)


def replace_scope(spark, sf_dir):
    """Tenders of one type in 1998 are replaced by those over 100,000; months as buckets."""
    rows = notices(spark, sf_dir).select(
        F.col("number").cast("string").alias("key"),
        "mode",
        F.date_format("day", "yyyy-MM").alias("day"),
        F.lit(0).alias("seq"),
        "business_type",
        "amount",
    )
    store = st.NoticeStore(spark, work_dir(spark, "store"))
    store.upsert(rows)
    job = (F.col("mode") == "bid") & F.col("day").startswith("1998") & (F.col("business_type") == "BUILDING")
    fresh = rows.where(job & (F.col("amount") > 100000)).withColumn("seq", F.lit(1))
    store.replace_scope(fresh, "bid", "1998-01", "1998-12", F.col("business_type") == "BUILDING")
    return store.read().select("key", "mode", "day", "business_type", "amount", "seq")


def compact_store(spark, sf_dir):
    """Rows kept under their month and read twice are regrouped to one row on its day."""
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("event_id").cast("string").alias("key"),
        F.lit("bid").alias("mode"),
        F.date_format("ts", "yyyy-MM-01").alias("day"),
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd").alias("real_day"),
        "value",
    )
    clicks = rows.where("event_type = 'click'").withColumns({"seq": F.col("seq") + 1, "value": F.col("value") + 1})
    store = st.NoticeStore(spark, work_dir(spark, "store"))
    store.upsert(rows.unionByName(clicks))
    store.compact(day=F.col("real_day"))
    return store.read().select("key", "day", "seq", "value")


def csv_roundtrip(spark, sf_dir):
    path = work_dir(spark, "csv")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    daily_csv.write_daily(documents, path)
    back = daily_csv.read_daily(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


def _daily_store(spark, sf_dir):
    """Notices as items in daily files, one day a month; items of the two modes have other keys, in another order."""
    root = work_dir(spark, "daily")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number, title, kind = (F.struct(F.lit(k), text(c)) for k, c in (("no", "number"), ("title, long", "title"), ("kind", "business_type")))
    office = F.struct(F.lit("office"), F.concat(F.lit("0"), text("institution"), F.lit(' "x"\n,')))
    items = F.when(F.col("mode") == "bid", F.array(number, title)).otherwise(F.array(kind, office, number))
    rows = notices(spark, sf_dir).select(
        "mode", F.date_format("day", "yyyy-MM-01").alias("day"), "number", F.map_from_entries(items).alias("item")
    )
    daily_csv.write_daily_files(rows, root, ["number"])
    return root


def daily_union(spark, sf_dir):
    """Daily files of a range, cells by the names in their headers."""
    root = _daily_store(spark, sf_dir)
    listed = daily_csv.list_partitions(spark, root, begin="1996-02-01", end="1996-12-31")
    back = daily_csv.read_daily(spark, [r["path"] for r in listed.collect()])
    return back.select("no", F.col("kind"), "office")


def list_days(spark, sf_dir):
    root = _daily_store(spark, sf_dir)
    return daily_csv.list_partitions(spark, root, begin="1995-06-01", mode="bid").select("mode", "day")


def stream_upsert(spark, sf_dir):
    """The changes in four files that mix old and new, one micro-batch each."""
    source, root = work_dir(spark, "stream-in"), work_dir(spark, "store")
    changes = _changes(spark, sf_dir)
    changes.repartition(4, F.col("seq") % 4).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_upsert(arriving, root, work_dir(spark, "stream-checkpoint")).awaitTermination()
    return st.NoticeStore(spark, root).read().select("key", "day", "seq", "event_type", "value")


def stream_keep_first(spark, sf_dir):
    """Every event arrives twice in one micro-batch and again in a later one; a fifth of the keys is blank."""
    source, sink = work_dir(spark, "stream-in"), work_dir(spark, "stream-out")
    k = F.col("event_id")
    key = F.when(k % 10 == 3, F.lit(None)).when(k % 10 == 7, F.lit("")).otherwise(F.concat(F.lit("e"), k))
    events = table(spark, sf_dir, "events").select(key.alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    # the second copy of every other event comes first
    arrivals = (F.lit(10), F.when(k % 2 == 0, 5).otherwise(15), F.lit(0))
    copies = [events.withColumns({"arrival": a.cast("int"), "copy": F.lit(i)}) for i, a in enumerate(arrivals)]
    for copy in copies:
        copy.coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(copies[0].schema).option("maxFilesPerTrigger", 2).parquet(source)
    first = streams.stream_keep_first(arriving, "key", "ts", "60 days", ["arrival", "copy"])
    query = (
        first.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", work_dir(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(copies[0].schema).parquet(sink).select("key", "event_id", "copy")


_LATEST = """SELECT 'bid:' || user_id AS key, strftime(ts, '%Y-%m-%d') AS day, event_id AS seq, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""

QUERIES = {
    "daily_counts": (
        daily_counts,
        f"SELECT mode, strftime(day, '%Y-%m-%d') AS day, count(*) AS count FROM ({NOTICES_SQL}) GROUP BY 1, 2",
    ),
    "carry_counts": (
        carry_counts,
        f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type FROM events),
        p AS (SELECT day, count(*) AS n FROM e WHERE day <= '{SPLIT_DAY}' GROUP BY 1),
        c AS (SELECT day, count(*) AS n FROM e WHERE day >= '2024-01-15' AND event_type <> 'view' GROUP BY 1)
        SELECT 'bid' AS mode, coalesce(c.day, p.day) AS day, coalesce(c.n, p.n) AS count FROM p FULL JOIN c ON p.day = c.day""",
    ),
    "upsert_relocate": (upsert_relocate, _LATEST),
    "daily_index": (
        daily_index,
        f"SELECT 'bid' AS mode, day AS date, count(*) AS count FROM ({_LATEST}) GROUP BY day",
    ),
    "locate_existing": (
        locate_existing,
        f"""WITH e AS (SELECT 'bid:' || user_id AS key, strftime(ts, '%Y-%m-%d') AS day, event_id AS seq FROM events),
        s AS (SELECT key, max(day) AS stored_day FROM e WHERE day <= '{SPLIT_DAY}' GROUP BY 1)
        SELECT e.key, e.seq, CASE WHEN s.key IS NOT NULL THEN 'bid' END AS stored_mode, stored_day
        FROM e LEFT JOIN s ON e.key = s.key WHERE e.day > '{SPLIT_DAY}'""",
    ),
    "replace_scope": (
        replace_scope,
        f"""WITH n AS (SELECT *, mode = 'bid' AND year(day) = 1998 AND business_type = 'BUILDING' AS scoped FROM ({NOTICES_SQL}))
        SELECT CAST(number AS VARCHAR) AS key, mode, strftime(day, '%Y-%m') AS day, business_type, amount,
          CASE WHEN scoped THEN 1 ELSE 0 END AS seq FROM n WHERE NOT scoped OR amount > 100000""",
    ),
    "compact_store": (
        compact_store,
        """SELECT CAST(event_id AS VARCHAR) AS key, strftime(ts, '%Y-%m-%d') AS day,
          event_id + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS seq,
          value + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS value FROM events""",
    ),
    "daily_union": (
        daily_union,
        f"""SELECT CAST(number AS VARCHAR) AS no, CASE WHEN mode = 'pre' THEN business_type ELSE '' END AS kind,
          CASE WHEN mode = 'pre' THEN '0' || institution || ' "x"' || chr(10) || ',' ELSE '' END AS office
        FROM ({NOTICES_SQL}) WHERE day BETWEEN DATE '1996-02-01' AND DATE '1996-12-31'""",
    ),
    "list_days": (
        list_days,
        f"SELECT DISTINCT mode, strftime(day, '%Y-%m-01') AS day FROM ({NOTICES_SQL}) WHERE mode = 'bid' AND day >= DATE '1995-06-01'",
    ),
    "csv_roundtrip": (csv_roundtrip, "SELECT doc_id, text, lang FROM documents"),
    "stream_upsert": (stream_upsert, _LATEST),
    "stream_keep_first": (
        stream_keep_first,
        """SELECT 'e' || event_id AS key, event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS copy
        FROM events WHERE event_id % 10 NOT IN (3, 7)
        UNION ALL SELECT CASE WHEN event_id % 10 = 7 THEN '' END, event_id, CAST(c AS INTEGER)
        FROM events, range(3) r(c) WHERE event_id % 10 IN (3, 7)""",
    ),
}
