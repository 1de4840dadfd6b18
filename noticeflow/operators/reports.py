"""Summaries and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import file_extension
from ..functions.nested import explode_rows
from ..functions.text import join_text

# Characters per token, price per million tokens and per document.
CHARS_PER_TOKEN = 1.2
PRICE_PER_MILLION = 5.0
PRICE_PER_DOCUMENT = 0.08
# Status texts of a report.
VERIFIED_TEXT = "통과"
UNVERIFIED_TEXT = "원문 확인 필요"
MISSING_ALERT = "누락: "


def run_summary(rows: DataFrame, errors: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: notices, attachments, copies dropped, errors, jobs and chunks of a run.

    ``rows`` has ``attachments`` (their number) and ``copies_dropped``; ``jobs`` has ``chunk``.
    """
    found = rows.agg(
        F.count(F.lit(1)).alias("notices"),
        F.coalesce(F.sum("attachments"), F.lit(0)).cast("long").alias("attachments"),
        F.coalesce(F.sum("copies_dropped"), F.lit(0)).cast("long").alias("copies_dropped"),
    )
    failed = errors.agg(F.count(F.lit(1)).alias("errors"))
    planned = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct("chunk").alias("chunks"))
    # three single rows side by side
    return found.crossJoin(failed).crossJoin(planned)


def kind_summary(manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents per notice by kind; everything with a reason counts as skipped."""
    return manifest.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "hwpx").alias("hwpx"),
        F.count_if(F.col("kind") == "pdf").alias("pdf"),
        F.count_if(F.col("reason").isNotNull()).alias("skipped"),
    )


def estimate_tokens(
    documents: DataFrame,
    chars: Column,
    keys: Sequence[str] = (),
    per_million: float = PRICE_PER_MILLION,
    per_document: float = PRICE_PER_DOCUMENT,
) -> DataFrame:
    """Estimated tokens and cost. Binary documents count half their bytes as ``chars``."""
    total = documents.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(chars), F.lit(0)).cast("long").alias("chars"),
    )
    tokens = F.ceil(F.col("chars") / CHARS_PER_TOKEN)
    cost = tokens / 1_000_000 * per_million + F.col("documents") * per_document
    return total.withColumns({"tokens": tokens, "cost": F.round(cost, 6)})


def document_chars(text: Column, content_length: Column) -> Column:
    """Characters of a text document, half the bytes of a binary one."""
    return F.coalesce(F.length(text), F.ceil(content_length / 2))


def extension_share(attachments: DataFrame, name: str, matched: Column) -> DataFrame:
    """Attachments by extension, with the share of all and of the matching ones."""
    counted = (
        attachments.groupBy(file_extension(name).alias("extension"))
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(matched).alias("matched"))
    )
    totals = counted.agg(F.sum("files").alias("_files"), F.sum("matched").alias("_matched"))
    shares = counted.crossJoin(F.broadcast(totals))  # one row of totals
    return shares.select(
        "extension",
        "files",
        "matched",
        F.round(F.col("files") / F.col("_files"), 6).alias("share"),
        F.round(F.try_divide(F.col("matched"), F.col("_matched")), 6).alias("matched_share"),
    )


def analysis_summary(results: DataFrame, items: str, analysed_at: str) -> DataFrame:
    """Index of analyses: items, verified flag and time, newest first."""
    rest = [c for c in results.columns if c != items]
    return results.select(*rest, F.size(items).alias("item_count")).orderBy(F.col(analysed_at).desc())


def item_alerts(missing: Column, errors: Column, items: Column) -> Column:
    """Alerts of one result: missing ids, verification errors, doubts about single items."""
    doubts = F.flatten(
        F.transform(
            items,
            lambda i: F.transform(
                i["doubts"], lambda d: F.concat(i["id"], F.lit(": "), d)
            ),
        )
    )
    return F.concat(F.transform(missing, lambda m: F.concat(F.lit(MISSING_ALERT), m)), errors, doubts)


def collect_alerts(df: DataFrame, keys: Sequence[str], alerts: Column) -> DataFrame:
    """One row per alert, in order."""
    return explode_rows(df, keys, alerts, "alert", "pos")


def explode_specs(items: DataFrame, keys: Sequence[str], specs: str = "specs") -> DataFrame:
    """One row per specification row of each item; items without any stay with nulls."""
    return items.select(*keys, F.posexplode_outer(specs).alias("spec_ix", "_s")).select(
        *keys, "spec_ix", "_s.*"
    )


def quantities(specs: Column, default: str | None = "-") -> Column:
    return join_text(F.transform(specs, lambda s: s["quantity"]), ", ", default)


def status_text(verified: Column) -> Column:
    return F.when(verified, F.lit(VERIFIED_TEXT)).otherwise(F.lit(UNVERIFIED_TEXT))


def export_requirements(notices: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of notices with their items: one line per item, nested lists as text.

    ``items`` has id, category, name, specs, deliverables, detail and verified.
    """
    return notices.join(items, list(keys)).select(
        *keys,
        "title",
        "id",
        "category",
        "name",
        quantities(F.col("specs"), None).alias("quantities"),
        join_text(F.col("deliverables"), ", ", None).alias("deliverables"),
        "detail",
        status_text(F.col("verified")).alias("status"),
    )


def requirement_report(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Item table of a report: empty lists are shown as '-', doubts as alerts."""
    doubts = F.transform(F.col("doubts"), lambda d: F.concat(F.col("id"), F.lit(": "), d))
    return items.select(
        *keys,
        "id",
        "category",
        "name",
        quantities(F.col("specs")).alias("quantities"),
        join_text(F.col("deliverables")).alias("deliverables"),
        F.size("specs").alias("spec_rows"),
        join_text(doubts, "\n", None).alias("alerts"),
        status_text(F.col("verified")).alias("status"),
    )
