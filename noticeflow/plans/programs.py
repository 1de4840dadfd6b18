"""The five data programs, put together from operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import digits8, record_day
from ..operators import dedup, documents, extraction, notices, positions, verification
from ..operators.notices import field_reader
from ..operators.sets import union_all
from ..sources.store import NoticeStore, complete_jobs, completed_jobs
from ..spec import BID, COLLECT_RANGE_DAYS, PRE, RESULTS_PER_PAGE, SourceSpec
from .config import CollectConfig
from .jobs import date_chunks, plan_jobs, resume_pending

_ARRIVAL = ["job_ix", "page", "item_ix"]
STORED = (
    "key string, mode string, day string, seq struct<run:int,job_ix:int,page:int,item_ix:int>, "
    "business_type string, item map<string,string>"
)


def search(items: DataFrame, spec: SourceSpec, filters: Mapping[str, str | None]) -> DataFrame:
    """Search result from landed items, newest first.

    ``items`` has ``item`` (map), the ``business_type`` asked for, and where it arrived
    (``job_ix``, ``page``, ``item_ix``). Copies are dropped before the filters.
    """
    found = notices.match_filters(_first_copies(items, spec), filters)
    return notices.newest_first(found, "published_at", *_ARRIVAL).drop(*_ARRIVAL)


def search_counts(items: DataFrame, spec: SourceSpec) -> DataFrame:
    """One row: ``items`` that arrived and ``copies_dropped`` among all of them, whatever the filters keep."""
    first = _first_copies(items, spec).select("copies_dropped")
    dropped = F.coalesce(F.sum("copies_dropped"), F.lit(0).cast("long"))
    return first.agg((F.count("*") + dropped).alias("items"), dropped.alias("copies_dropped"))


def _first_copies(items: DataFrame, spec: SourceSpec) -> DataFrame:
    mapped = notices.map_notice(items, spec, F.col("business_type"), keep=_ARRIVAL)
    return dedup.keep_first(mapped, "number", _ARRIVAL, copies="copies_dropped")


def collect_plan(spark, config: CollectConfig) -> DataFrame:
    """Jobs of a collection: chunks, modes and business types."""
    modes = spark.createDataFrame([(m,) for m in config.modes], "mode string")
    types = spark.createDataFrame([(t,) for t in config.business_types], "business_type string")
    chunks = date_chunks(spark, config.begin, config.end, COLLECT_RANGE_DAYS).drop("chunk")
    return plan_jobs(chunks, modes, types)


def store_rows(items: DataFrame, run: int) -> DataFrame:
    """Landed items as rows of the store. Later runs and later arrivals win."""
    read = field_reader(items)
    published = F.coalesce(F.nullif(read(PRE.published_at[0]), F.lit("")), read(BID.published_at[0]))
    return items.select(
        notices.record_key(read).alias("key"),
        notices.record_mode(read).alias("mode"),
        record_day(published).alias("day"),
        F.struct(F.lit(run).alias("run"), *_ARRIVAL).alias("seq"),
        "business_type",
        "item",
    )


def collect(
    store: NoticeStore,
    plan: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    resume: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Read pending jobs, merge their notices, then record the jobs as complete.

    ``read`` lands what it reads and returns it: job_id, business_type, job_ix, page, item_ix,
    item and error. A job with an error is dropped as a whole and stays pending. Without
    ``resume`` all jobs are read, and each replaces what is stored in its range. Returns the
    failed jobs and the changes that could not be placed.
    """
    spark = store.spark
    done = completed_jobs(spark, store.root, "job_id string")
    pending = resume_pending(plan, done, resume=resume)
    landed = read(pending)
    failed = landed.where("error is not null").select("job_id", "error").distinct()
    good = landed.where("error is null").join(failed, "job_id", "left_anti")
    rows = store_rows(good, _next_run(store))
    succeeded = pending.join(failed, "job_id", "left_anti")
    if resume:
        rejected = store.upsert(rows)
    else:
        scopes = _scopes(succeeded)
        if not scopes:  # every job failed: what is stored stays
            return failed, None
        begin, end = min(s[2] for s in scopes), max(s[3] for s in scopes)
        scope = reduce(Column.__or__, [notices.in_job_scope(m, b, e, t) for m, t, b, e in scopes])
        rejected = store.replace_scope(rows, None, begin, end, scope)
    complete_jobs(spark, store.root, succeeded.select("job_id"))
    return failed, rejected


def _next_run(store: NoticeStore) -> int:
    """One more than the last run of which rows are stored."""
    rows = store.read()
    last = None if rows is None else rows.agg(F.max(F.col(store.order)["run"])).first()[0]
    return (last or 0) + 1


def _scopes(jobs: DataFrame) -> list[tuple[str, str, str, str]]:
    """(mode, type, begin, end) of the jobs, adjoining ranges joined. A plan is small."""
    ranges = jobs.select(
        "mode", "business_type", F.col("chunk_begin").alias("b"), F.col("chunk_end").alias("e")
    )
    merged: list[list] = []
    for mode, type_, begin, end in sorted(map(tuple, ranges.collect())):
        last = merged[-1] if merged else None
        if last and last[:2] == [mode, type_] and (begin - last[3]).days == 1:
            last[3] = end
        else:
            merged.append([mode, type_, begin, end])
    return [(m, t, b.isoformat(), e.isoformat()) for m, t, b, e in merged]


def downloads(
    records: DataFrame,
    spec: SourceSpec = BID,
    institutions: tuple[str, ...] = (),
    pattern: str = ".",
    *,
    limit: int,
) -> DataFrame:
    """Attachments to fetch: the ``limit`` newest notices of the institutions, matching files only.

    ``records`` has ``item`` (map) and ``arrival`` (a number).
    """
    mapped = notices.map_records(records, F.lit(spec.mode), keep=["arrival"], attach=False).where("number <> ''")
    wanted = notices.institution_any(mapped, institutions)
    dated = wanted.withColumn("_date", digits8("published_at"))
    latest = dedup.latest_per_key(dated, "number", "_date", "arrival")
    selected = notices.select_attachments(latest, limit, pattern, "_date", "arrival")
    return notices.download_list(selected.drop("_date", "arrival", "notice_kind"))


def texts(files: DataFrame) -> DataFrame:
    """Manifest of attached files with the Markdown of each document."""
    return documents.convert_documents(files).withColumn("markdown", documents.to_markdown("blocks"))


def verified_results(responses: DataFrame, sources: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Verified extraction results from answers as JSON text in ``raw``, and the failed ones with their reason.

    ``sources`` has the keys and ``markdown``, with an optional ``sequence``: the documents of a notice are put together
    in its order, and a result is verified against all of them.
    """
    order = [F.col("sequence")] if "sequence" in sources.columns else []
    part = F.struct(*order, F.col("markdown"))
    whole = sources.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["markdown"]), "\n\n").alias("markdown")
    )
    parsed = responses.select(*keys, "raw", extraction.normalise_keys("raw").alias("_r"))
    results = parsed.where("_r is not null").select(*keys, "_r.*")
    failed = parsed.where("_r is null").select(*keys, "raw", F.lit("the answer is no JSON object").alias("reason"))
    return verification.verify_results(results, whole, keys), failed


def browse(
    store: NoticeStore,
    begin: date,
    end: date,
    query: str | None = None,
    mode: str | None = None,
    business_type: str | None = None,
    analyses: DataFrame | None = None,
    page: int = 1,
) -> DataFrame:
    """One page of stored notices, newest first, with the state of their analysis."""
    rows = store.read(begin.isoformat(), end.isoformat(), mode or None)
    if rows is None:  # nothing was ever stored
        rows = store.spark.createDataFrame([], STORED)
    specs = [s for s in (PRE, BID) if mode in (None, "", s.mode)]
    shown = union_all(
        *[
            notices.map_notice(rows.where(F.col("mode") == s.mode), s, F.col("business_type"), keep=["key"])
            for s in specs
        ]
    )
    found = notices.keyword_search(shown, query)
    found = notices.optional_equals(found, business_type=business_type)
    visible = positions.page(found, ["published_at", "key"], page, RESULTS_PER_PAGE, descending=["published_at"])
    if analyses is not None:
        visible = notices.attach_analysis(visible, analyses)
    return visible.orderBy(F.col("published_at").desc(), "key")
