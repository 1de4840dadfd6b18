"""Checks of extraction results against their source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import hyphenate, id_filter, loose_ids
from ..functions.text import let, normalise_ws, strip_ws
from ..spec import QUOTE_CHARS

# Message texts.
MISSING = "상세 추출 누락: "
UNEXPECTED = "총괄표에 없는 ECR: "
COUNT_DIFFERS = ("총괄표 ECR 수 불일치: 선언 ", ", 목록 ")
TOO_SHORT = ": 세부내용_원문이 너무 짧음"
NOT_IN_TEXT = ": 세부내용_원문이 변환 Markdown에서 확인되지 않음"
ID_NOT_IN_TEXT = "변환 텍스트에서 확인되지 않은 ID(경고): "


def _listed(prefix: str, ids: Column) -> Column:
    """A one-message array naming the ids, empty when there are none."""
    text = F.concat(F.lit(prefix), F.array_join(ids, ", "))
    return F.when(F.size(ids) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def detail_errors(items: Column, markdown: Column) -> Column:
    """One message per item whose quoted detail is short or does not occur in the text."""

    def check(item: Column, source: Column) -> Column:
        quote = F.substring(normalise_ws(item["detail"]), 1, QUOTE_CHARS)
        return F.when(F.length(quote) < QUOTE_CHARS, F.concat(item["id"], F.lit(TOO_SHORT))).when(
            ~F.contains(source, quote), F.concat(item["id"], F.lit(NOT_IN_TEXT))
        )

    messages = let(
        normalise_ws(markdown), lambda source: F.transform(items, lambda item: check(item, source))
    )
    return F.array_compact(messages)


def verification(expected: Column, declared: Column, items: Column, markdown: Column) -> Column:
    """Verification struct of one result.

    ``expected`` are the ids of the summary table, ``declared`` its stated total, ``items`` an
    array of (id, detail), ``markdown`` the text of the documents. All are bound to one result,
    so the checks stay inside the row.
    """
    ids = F.transform(items, lambda i: strip_ws(i["id"]))
    actual = F.array_distinct(F.filter(ids, lambda i: i != ""))
    return let(
        id_filter(expected),
        lambda wanted: let(
            actual, lambda found: _verify(wanted, found, declared, items, markdown)
        ),
    )


def _verify(wanted: Column, actual: Column, declared: Column, items: Column, markdown: Column) -> Column:
    none = F.array().cast("array<string>")
    counts = F.concat(
        F.lit(COUNT_DIFFERS[0]), declared.cast("string"), F.lit(COUNT_DIFFERS[1]), F.size(wanted).cast("string")
    )
    differs = F.coalesce(F.when(declared != F.size(wanted), F.array(counts)), none)
    spelled = F.array_distinct(F.transform(wanted, hyphenate))
    absent = F.array_except(spelled, loose_ids(markdown))

    def result(missing: Column) -> Column:
        errors = F.concat(
            _listed(MISSING, missing),
            let(F.array_except(actual, wanted), lambda u: _listed(UNEXPECTED, u)),
            differs,
            detail_errors(items, markdown),
        )
        return let(
            errors,
            lambda e: F.struct(
                (F.size(e) == 0).alias("verified"),
                e.alias("errors"),
                let(absent, lambda a: _listed(ID_NOT_IN_TEXT, a)).alias("warnings"),
                wanted.alias("expected_ids"),
                actual.alias("actual_ids"),
                missing.alias("missing"),
            ),
        )

    return let(F.array_except(wanted, actual), result)


def verify_results(results: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Join extraction results (see ``spec.EXTRACTION``) with their texts and verify them."""
    items = F.transform(
        F.col("ecr"),
        lambda i: F.struct(i["id"].alias("id"), i["세부내용_원문"].alias("detail")),
    )
    expected = F.transform(F.col("요구사항목록"), lambda r: r["ID"])
    joined = results.join(texts, keys, "left")
    return joined.withColumn(
        "verification",
        verification(expected, F.col("요구사항수"), items, F.coalesce("markdown", F.lit(""))),
    )
