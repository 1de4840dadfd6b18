"""Notice projection, attachments, filters and ordering."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions import dates, names
from ..functions.nested import explode_rows
from ..functions.text import fold, let, non_empty, strip_ws
from ..spec import BID, FILE_ARRAY, PRE, RECORD_KIND_FIELD, RECORD_TYPE_FIELD, SourceSpec


def field_reader(df: DataFrame, item: str = "item"):
    """Accessor of record fields, from columns or from a map column; absent fields are null."""
    if item in df.columns and isinstance(df.schema[item].dataType, MapType):
        return lambda name: F.try_element_at(F.col(item), F.lit(name))
    present = set(df.columns)
    return lambda name: F.col(name) if name in present else F.lit(None).cast("string")


def record_mode(read) -> Column:
    """Mode of a record: a tender number makes it a tender."""
    has = lambda spec: F.coalesce(read(spec.number), F.lit("")) != ""
    return F.when(has(BID), F.lit(BID.mode)).when(has(PRE), F.lit(PRE.mode)).otherwise(F.lit(""))


def record_key(read) -> Column:
    """``mode:number`` with the number of the record's own mode; '' without a number."""
    mode = record_mode(read)
    number = strip_ws(F.when(mode == BID.mode, read(BID.number)).otherwise(read(PRE.number)))
    return F.when(number == "", F.lit("")).otherwise(F.concat_ws(":", mode, number))


def map_notice(
    df: DataFrame,
    spec: SourceSpec,
    business_type: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project records of one mode to notice columns.

    Each value is the first non-empty alternative. ``business_type`` is the type that was
    asked for; without it the record's own type is used.
    """
    read = field_reader(df)
    columns = _projected(read, spec, business_type) | {"files": unpivot_attachments(read, spec)}
    return df.select(*keep, *[c.alias(name) for name, c in columns.items()])


def map_records(
    df: DataFrame, mode: Column, business_type: Column | None = None, keep: Sequence[str] = (), attach: bool = True
) -> DataFrame:
    """:func:`map_notice` for records of both modes in one pass; ``mode`` decides for each record.

    Without ``attach`` the attachment fields stay as they are in ``record``, for :func:`with_files` after rows were chosen.
    """
    read = field_reader(df)
    pre, bid = (_projected(read, spec, business_type) for spec in (PRE, BID))
    is_bid = mode == BID.mode
    columns = {name: F.when(is_bid, bid[name]).otherwise(pre[name]) for name in pre}
    fields = [f"{prefix}{i}" for s in (PRE, BID) for prefix in (s.url_prefix, s.name_prefix) if prefix for i in range(1, s.slots + 1)]
    record = F.struct(*[read(f).alias(f) for f in fields])
    mapped = df.select(*keep, *[c.alias(name) for name, c in columns.items()], record.alias("record"))
    return with_files(mapped) if attach else mapped


def with_files(mapped: DataFrame) -> DataFrame:
    """The attachments of mapped records in place of their ``record``."""
    read = lambda name: F.col("record")[name]
    files = F.when(F.col("mode") == BID.mode, unpivot_attachments(read, BID)).otherwise(unpivot_attachments(read, PRE))
    return mapped.withColumn("files", files).drop("record")


def _projected(read, spec: SourceSpec, business_type: Column | None) -> dict[str, Column]:
    return {
        "mode": F.lit(spec.mode),
        "number": strip_ws(read(spec.number)),
        "institution": non_empty(*[read(c) for c in spec.institution]),
        "business_type": non_empty(read(RECORD_TYPE_FIELD)) if business_type is None else business_type,
        "notice_kind": non_empty(read(RECORD_KIND_FIELD)),
        "title": non_empty(*[read(c) for c in spec.title]),
        "published_at": non_empty(*[read(c) for c in spec.published_at]),
        "close_at": non_empty(*[read(c) for c in spec.close_at]),
    }


def unpivot_attachments(read, spec: SourceSpec) -> Column:
    """Numbered attachment fields as an array: web addresses only, first copy of each."""
    slots = F.array(
        *[
            F.struct(
                strip_ws(read(f"{spec.url_prefix}{i}")).alias("url"),
                strip_ws(read(f"{spec.name_prefix}{i}") if spec.name_prefix else F.lit("")).alias("name"),
                F.lit(i).alias("slot"),
            )
            for i in range(1, spec.slots + 1)
        ]
    )
    valid = F.filter(slots, lambda f: names.url_guard(f["url"], strict=True))

    def first_copies(files: Column) -> Column:
        addresses = F.transform(files, lambda f: f["url"])
        return let(
            addresses,
            lambda urls: F.filter(files, lambda f, i: F.array_position(urls, f["url"]) == i + 1),
        )

    def fallback(file: Column, index: Column) -> Column:
        if spec.guess_names:
            return names.guess_name(file["url"], index)
        return F.concat_ws(" ", F.lit(names.ATTACHMENT_LABEL), file["slot"].cast("string"))

    named = F.transform(
        let(valid, first_copies),
        lambda f, i: F.struct(
            f["url"].alias("url"),
            non_empty(f["name"], fallback(f, i)).alias("name"),
            f["slot"].alias("slot"),
        ),
    )
    return named.cast(FILE_ARRAY)


def attachment_count(files: Column | str = "files") -> Column:
    """Number of attachments; 0 for none."""
    return F.coalesce(F.size(files), F.lit(0))


def count_attachments(
    notices: DataFrame, attachments: DataFrame, keys: Sequence[str], selective: bool = False
) -> DataFrame:
    """Add ``attachments``: rows of an attachment relation per notice, 0 kept.

    ``selective`` is for few notices: other attachments are dropped before they are counted.
    """
    if selective:
        attachments = attachments.join(notices.select(*keys), list(keys), "left_semi")
    counted = attachments.groupBy(*keys).agg(F.count(F.lit(1)).alias("attachments"))
    return notices.join(counted, list(keys), "left").fillna(0, ["attachments"])


def explode_files(df: DataFrame, files: str = "files") -> DataFrame:
    """One row per attachment, with ``url``, ``name`` and ``slot``."""
    rest = [c for c in df.columns if c != files]
    return explode_rows(df, rest, F.col(files), "_file").select(
        *rest, "_file.url", "_file.name", "_file.slot"
    )


# ---- filters


def match_filters(df: DataFrame, filters: Mapping[str, str | None]) -> DataFrame:
    """AND of substring matches that ignore whitespace and case; blank filters are skipped."""
    for column, wanted in filters.items():
        query = re.sub(r"[\s\ufeff]", "", wanted or "").lower()
        if query:
            df = df.where(F.contains(fold(column), F.lit(query)))
    return df


def keyword_search(
    df: DataFrame, query: str | None, columns: Sequence[str] = ("number", "institution", "title")
) -> DataFrame:
    """One case-insensitive substring over the joined columns."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return df
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted)))


def date_range(
    df: DataFrame,
    column: str,
    begin: date,
    end: date,
    today: date | None = None,
) -> DataFrame:
    """Rows whose day lies in the inclusive range."""
    dates.check_range(begin, end, today)
    return df.where(F.col(column).between(F.lit(begin), F.lit(end)))


def optional_equals(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality per column; a blank value is no filter."""
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def institution_any(
    df: DataFrame,
    names_wanted: Iterable[str] = (),
    codes: Iterable[str] = (),
    name: str = "institution",
    code: str = "institution_code",
) -> DataFrame:
    """Any code equal, or any name contained; codes win over names; nothing wanted keeps all."""
    codes, names_wanted = list(codes), list(names_wanted)
    if codes:
        return df.where(F.col(code).isin(codes))
    if not names_wanted:
        return df
    return df.where(reduce(Column.__or__, [F.col(name).contains(n) for n in names_wanted]))


def file_pattern(files: Column | str, pattern: str = ".") -> Column:
    """Attachments whose name matches a case-insensitive pattern, filtered inside the array."""
    return F.filter(files, lambda f: f["name"].rlike(f"(?i){pattern}"))


def in_job_scope(mode: str, begin: str, end: str, business_type: str) -> Column:
    """Rows that a repeated job replaces."""
    return (
        (F.col("mode") == mode)
        & F.col("day").between(begin, end)
        & (F.col("business_type") == business_type)
    )


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the named columns where present."""
    return df.drop(*columns)


def latest_window(df: DataFrame, day: str, days: int = 7) -> DataFrame:
    """The last ``days`` days up to the newest day present."""
    newest = df.select(F.max(day)).scalar()
    return df.where(F.col(day) >= F.date_sub(newest, days - 1))


# ---- order and limit


def newest_first(df: DataFrame, published: str, *ties: str | Column) -> DataFrame:
    """Newest first, blanks last, ties by arrival."""
    return df.orderBy(F.nullif(F.col(published).cast("string"), F.lit("")).desc_nulls_last(), *ties)


def top_notices(df: DataFrame, n: int, published: str, *ties: str | Column) -> DataFrame:
    """The newest ``n`` notices. Attachment filters come after this limit."""
    return newest_first(df, published, *ties).limit(n)


def select_attachments(
    notices: DataFrame, n: int, pattern: str, published: str, *ties: str | Column
) -> DataFrame:
    """Matching attachments of the newest ``n`` notices; notices without a match drop out.

    Attachments of notices that still have their ``record`` are built after the limit.
    """
    top = top_notices(notices, n, published, *ties)
    if "record" in top.columns:
        top = with_files(top)
    matched = top.withColumn("files", file_pattern("files", pattern))
    return matched.where(F.size("files") > 0)


def download_list(selected: DataFrame) -> DataFrame:
    """One row per attachment to fetch, with its slot after filtering and target file name."""
    rest = [c for c in selected.columns if c != "files"]
    exploded = explode_rows(selected, rest, F.col("files"), "_file")
    slot = F.col("_pos") + 1
    fallback = F.concat(F.lit("attachment_"), slot.cast("string"))
    return exploded.select(
        *rest,
        slot.alias("slot"),
        F.col("_file.url").alias("url"),
        F.col("_file.name").alias("name"),
        names.numbered_name(slot, F.col("_file.name"), fallback).alias("target"),
    )


# ---- joins


def attach_analysis(notices: DataFrame, analyses: DataFrame, keys: Sequence[str] = ("mode", "number")) -> DataFrame:
    """Left join of the analysis summary; notices without an analysis keep nulls."""
    return notices.join(analyses, list(keys), "left")


def natural_order(name: Column | str) -> list[Column]:
    """Sort expressions that order numbered names by their number."""
    column = F.col(name) if isinstance(name, str) else name
    return [
        F.regexp_extract(column, r"^(\D*)", 1),
        F.try_to_number(F.regexp_extract(column, r"(\d+)", 1), F.lit("9" * 18)),
        column,
    ]
