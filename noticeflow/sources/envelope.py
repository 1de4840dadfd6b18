"""Paged API responses landed as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nested import explode_rows
from ..functions.text import let, non_empty
from ..spec import PAGE_SIZE

# The words by which a message tells that the requested range is too long, and
# the length of the preview kept from a response that is not JSON.
RANGE_WORDS = "(?i)기간|범위|초과|개월|일자|PERIOD|RANGE"
PREVIEW_CHARS = 400
# Fixed value: trimming leaves these characters off both ends of a response body.
JSON_START = r"^[\s\uFEFF]*[{\[]"

OK, TRANSIENT, RANGE_ERROR, ERROR = "ok", "transient", "range_error", "error"


def _get(variant: Column, path: str, type_: str) -> Column:
    return F.try_variant_get(variant, path, type_)


def envelope_items(raw: Column) -> Column:
    """Items of a response as ``array<map<string,string>>``.

    ``items`` may be a list, an object holding a list or a single object under ``item``, or
    absent. Nested values stay JSON text.
    """
    none = F.array().cast("array<map<string,string>>")

    def listed(items: Column) -> Column:
        one = let(
            _get(items, "$.item", "map<string,string>"), lambda i: F.when(i.isNotNull(), F.array(i))
        )
        return F.coalesce(
            _get(items, "$", "array<map<string,string>>"),
            _get(items, "$.item", "array<map<string,string>>"),
            one,
            none,
        )

    return let(_get(F.try_parse_json(raw), "$.response.body.items", "variant"), listed)


def parse_envelope(df: DataFrame, raw: str = "body") -> DataFrame:
    """One row per item with its position ``item_ix`` in the page."""
    rest = [c for c in df.columns if c != raw]
    return explode_rows(df, rest, envelope_items(F.col(raw)), "item", "item_ix")


def envelope_totals(raw: Column) -> Column:
    """Declared ``total`` and ``page_size`` of a response."""
    return let(
        F.try_parse_json(raw),
        lambda v: F.struct(
            F.coalesce(_number(v, "$.response.body.totalCount"), F.lit(0).cast("long")).alias("total"),
            F.coalesce(
                F.nullif(_number(v, "$.response.body.numOfRows"), F.lit(0)), F.lit(PAGE_SIZE)
            ).cast("int").alias("page_size"),
        ),
    )


def _number(variant: Column, path: str) -> Column:
    return _get(variant, path, "string").try_cast("long")


def _retryable(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def classify(status: Column, body: Column) -> Column:
    """``ok``, ``transient``, ``range_error`` or ``error`` for a response.

    A response that is no JSON comes from a gateway on the way and may pass on a repeat.
    """
    text = F.coalesce(body, F.lit(""))
    kind = let(F.try_parse_json(text), lambda v: _classify_json(status, v, text))
    return F.when(text.rlike(JSON_START), kind).otherwise(F.lit(TRANSIENT))


def _classify_json(status: Column, variant: Column, text: Column) -> Column:
    upstream = F.coalesce(_number(variant, "$.upstreamStatus"), F.lit(0))
    return (
        F.when(_retryable(status) | _retryable(upstream), F.lit(TRANSIENT))
        .when(_get(variant, "$.response.body", "variant").isNotNull(), F.lit(OK))
        .when(_message(variant, text).rlike(RANGE_WORDS), F.lit(RANGE_ERROR))
        .otherwise(F.lit(ERROR))
    )


def _message(variant: Column, text: Column) -> Column:
    return non_empty(_get(variant, "$.response.header.resultMsg", "string"), text)


def message(body: Column) -> Column:
    """Header message, else the response itself; a preview when it is not JSON."""
    found = let(F.try_parse_json(body), lambda v: _message(v, body))
    return F.when(body.rlike(JSON_START), found).otherwise(F.substring(body, 1, PREVIEW_CHARS))
