import json

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import extraction, verification

FIRST = "두 전산실의 예비 전원을 매달 한 차례 이상 시험하고 그 기록과 조치 내역을 열흘 안에 보고한다."
SECOND = "야간 백업이 실패하면 담당자는 다음 근무 시작 전까지 원인을 찾아 다시 실행하고 결과를 남긴다."
TEXT = f"ECR-PWR-07 {FIRST}\nECR-BAK-12 {SECOND}"


@pytest.fixture
def verify(spark):
    def run(ids=("ECR-PWR-07", "ECR-BAK-12"), declared=2, items=None, text=TEXT):
        items = {"ECR-PWR-07": FIRST, "ECR-BAK-12": SECOND} if items is None else items
        raw = {
            "요구사항수": declared,
            "요구사항목록": [{"ID": i} for i in ids],
            "ecr": [{"id": i, "세부내용_원문": d} for i, d in items.items()],
        }
        df = spark.createDataFrame([("n", json.dumps(raw, ensure_ascii=False), text)], "notice string, raw string, markdown string")
        results = df.select("notice", extraction.normalise_keys("raw").alias("r")).select("notice", "r.*")
        made = verification.verify_results(results, df.select("notice", "markdown"), ["notice"])
        return made.select("verification.*").first()

    return run


def test_verified(verify):
    made = verify()
    assert made["verified"] and not made["errors"] and not made["warnings"]
    assert made["expected_ids"] == ["ECR-PWR-07", "ECR-BAK-12"] == made["actual_ids"]


def test_whitespace_does_not_matter(verify):
    assert verify(items={"ECR-PWR-07": FIRST.replace(" ", "\n　"), "ECR-BAK-12": SECOND})["verified"]


@pytest.mark.parametrize(
    "change, error",
    [
        ({"items": {"ECR-PWR-07": FIRST}}, "상세 추출 누락: ECR-BAK-12"),
        ({"ids": ["ECR-PWR-07"], "declared": 1}, "총괄표에 없는 ECR: ECR-BAK-12"),
        ({"declared": 3}, "총괄표 ECR 수 불일치: 선언 3, 목록 2"),
        ({"items": {"ECR-PWR-07": FIRST[:39], "ECR-BAK-12": SECOND}}, "ECR-PWR-07: 세부내용_원문이 너무 짧음"),
        (
            {"items": {"ECR-PWR-07": "x" + FIRST, "ECR-BAK-12": SECOND}},
            "ECR-PWR-07: 세부내용_원문이 변환 Markdown에서 확인되지 않음",
        ),
    ],
)
def test_errors(verify, change, error):
    made = verify(**change)
    assert not made["verified"] and list(made["errors"]) == [error]


def test_undeclared_total_passes(verify):
    assert verify(declared=None)["verified"]


def test_id_missing_from_text_is_a_warning(verify):
    made = verify(text=TEXT.replace("ECR-BAK-12", "ECR-BAK-1"))
    assert made["verified"] and list(made["warnings"]) == ["변환 텍스트에서 확인되지 않은 ID(경고): ECR-BAK-12"]


def test_dash_spelling_of_ids(verify):
    made = verify(ids=["ECR–PWR-07", "ECR-BAK-12"], items={"ECR–PWR-07": FIRST, "ECR-BAK-12": SECOND})
    assert made["verified"] and not made["warnings"]


def test_other_requirements_are_not_expected(verify):
    made = verify(ids=["ECR-PWR-07", "ECR-BAK-12", "SER-1", " "])
    assert made["verified"] and made["expected_ids"] == ["ECR-PWR-07", "ECR-BAK-12"]


def test_result_without_text(spark, verify):
    assert not verify(text="")["verified"]
