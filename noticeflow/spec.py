"""What differs between the kinds of notices, and fixed record schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


@dataclass(frozen=True)
class SourceSpec:
    """Field names of one kind of notice. Alternatives are tried in order."""

    mode: str
    number: str
    institution: tuple[str, ...]
    title: tuple[str, ...]
    published_at: tuple[str, ...]
    close_at: tuple[str, ...]
    url_prefix: str
    slots: int
    name_prefix: str | None = None
    #: Whether an attachment without a stored name is named by its address.
    guess_names: bool = False
    revision: str | None = None


# Field names and slot counts of the two published record kinds.
PRE = SourceSpec(
    mode="pre",
    number="bfSpecRgstNo",
    institution=("rlDminsttNm", "dminsttNm"),
    title=("prdctClsfcNoNm",),
    published_at=("rgstDt",),
    close_at=("opninRgstClseDt",),
    url_prefix="specDocFileUrl",
    slots=5,
    name_prefix="specDocFileNm",
    guess_names=True,
)
BID = SourceSpec(
    mode="bid",
    number="bidNtceNo",
    institution=("dminsttNm",),
    title=("bidNtceNm",),
    published_at=("bidNtceDt",),
    close_at=("bidClseDt",),
    url_prefix="ntceSpecDocUrl",
    slots=10,
    name_prefix="ntceSpecFileNm",
)
SPECS = {spec.mode: spec for spec in (PRE, BID)}

# Accepted names of modes, and the business types of requests.
MODE_ALIASES = {"사전공고": "pre", "본공고": "bid", "pre": "pre", "bid": "bid"}
BUSINESS_TYPES = ("물품", "외자", "용역", "공사")
RECORD_TYPE_FIELD = "bsnsDivNm"
RECORD_KIND_FIELD = "ntceKindNm"

# Request limits.
PAGE_SIZE = 999
SEARCH_RANGE_DAYS = 30
COLLECT_RANGE_DAYS = 28
FALLBACK_RANGE_DAYS = 28
MAX_SPLIT_DEPTH = 6
RETRIES = 3
RETRY_SECONDS = 0.8
RESULTS_PER_PAGE = 50
IDS_PER_REQUEST_LOCAL = 2
IDS_PER_REQUEST_HOSTED = 15
RETRY_ROUNDS = 3
QUOTE_CHARS = 40

FILE_ARRAY = "array<struct<url:string,name:string,slot:int>>"


def _strings(*names: str) -> list[StructField]:
    return [StructField(name, StringType()) for name in names]


_REQUIREMENT = StructType(_strings("구분", "ID", "명칭"))
_SPEC_ROW = StructType(_strings("구분", "항목", "요구사항", "수량"))
_ITEM = StructType(
    [
        *_strings("id", "분류", "명칭", "정의", "세부내용_원문"),
        StructField("기본규격", ArrayType(_SPEC_ROW)),
        StructField("파생규격", StructType(_strings("cpu", "ram", "gpu", "disk", "nic", "기타"))),
        StructField("산출물", ArrayType(StringType())),
        *_strings("출처"),
        StructField("불확실", ArrayType(StringType())),
    ]
)

# The shape of an extraction result.
EXTRACTION = StructType(
    [
        StructField("사업개요", StructType(_strings("사업명", "수요기관", "사업기간", "예산", "계약방식"))),
        StructField("ID부여규칙", StringType()),
        StructField("요구사항수", IntegerType()),
        StructField("요구사항목록", ArrayType(_REQUIREMENT)),
        StructField("ecr", ArrayType(_ITEM)),
        StructField("누락", ArrayType(StringType())),
        StructField("기타요구사항", ArrayType(_REQUIREMENT)),
    ]
)
EXTRACTION_VERSION = 1
OPTIONAL_EXTRACTION_FIELDS = frozenset({"요구사항수"})
