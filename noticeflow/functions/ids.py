"""Requirement ids in text, and the text around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let, strip_ws

# Id patterns. No word boundary is used, because ids are often glued to Hangul.
STRICT_ID = r"ECR-\d{3}(?!\d)"
PROMPT_ID = r"ECR[-–][A-Z0-9-]+"
LOOSE_ID = r"[A-Z]{2,4}[-–][A-Z0-9-]+"
ECR_PREFIX = "(?i)^ECR[-–]"

# Characters of source text sent around an id, and for a summary.
BEFORE_ID = 220
FROM_ID = 1350
HEAD_CHARS = 6200
PART_SEPARATOR = "\n\n---\n\n"


def extract_ids(text: Column | str, pattern: str = STRICT_ID) -> Column:
    """Distinct ids in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)))


def hyphenate(identifier: Column) -> Column:
    """One spelling for ids written with an en dash."""
    return F.replace(identifier, F.lit("–"), F.lit("-"))


def loose_ids(text: Column | str) -> Column:
    """Distinct ids of any kind, en dashes as hyphens."""
    found = F.regexp_extract_all(_col(text), F.lit(LOOSE_ID), F.lit(0))
    return F.array_distinct(F.transform(found, hyphenate))


def id_filter(ids: Column) -> Column:
    """Distinct trimmed ids that name an ECR requirement."""
    trimmed = F.transform(ids, strip_ws)
    return F.array_distinct(F.filter(trimmed, lambda i: i.rlike(ECR_PREFIX)))


def excerpt_window(
    text: Column | str, identifier: Column, backwards: Column | None = None
) -> Column:
    """Text around the last place an id occurs; a marker when it does not occur.

    ``backwards`` is the reversed text, for callers that cut several windows from one text.
    """
    source = _col(text)
    backwards = F.reverse(source) if backwards is None else backwards
    missing = F.concat(F.lit("["), identifier, F.lit(" 원문을 찾지 못함]"))

    def cut(found: Column) -> Column:
        # ``found`` counts from the end of the text, 1-based, to the end of the id.
        at = F.length(source) - found + 1 - F.length(identifier)
        start = F.greatest(at - BEFORE_ID, F.lit(0))
        window = F.substring(source, start + 1, at + FROM_ID - start)
        return F.when(found == 0, missing).otherwise(window)

    return let(F.position(F.reverse(identifier), backwards), cut)


def head(text: Column | str) -> Column:
    return F.substring(_col(text), 1, HEAD_CHARS)
