import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from noticeflow.plans import programs
from noticeflow.plans.config import collect_config
from noticeflow.sources.store import NoticeStore
from noticeflow.spec import BID, PRE


def items(spark, *rows):
    return spark.createDataFrame(
        [(job, 1, i, "용역", item) for i, (job, item) in enumerate(rows)],
        "job_ix int, page int, item_ix int, business_type string, item map<string,string>",
    )


def test_search(spark):
    landed = items(
        spark,
        (1, {"bfSpecRgstNo": "1", "prdctClsfcNoNm": "망 구축", "rgstDt": "2024-01-02", "dminsttNm": "a"}),
        (0, {"bfSpecRgstNo": "1", "prdctClsfcNoNm": "first", "rgstDt": "2024-01-01"}),
        (0, {"bfSpecRgstNo": "2", "prdctClsfcNoNm": "망구축", "rgstDt": "2024-01-01", "rlDminsttNm": "b", "dminsttNm": "a"}),
        (0, {"bfSpecRgstNo": "", "prdctClsfcNoNm": "신규 망구축", "rgstDt": ""}),
        (2, {"bfSpecRgstNo": "3", "prdctClsfcNoNm": "망 구축", "rgstDt": "2024-03-01"}),
    )
    found = programs.search(landed, PRE, {"title": "망구 축", "number": ""}).collect()
    assert [(r["number"], r["institution"], r["copies_dropped"]) for r in found] == [("3", "", 0), ("2", "b", 0), ("", "", 0)]
    # the copy of a notice that the filter leaves out is counted as well
    assert tuple(programs.search_counts(landed, PRE).first()) == (5, 1)
    assert tuple(programs.search_counts(landed.limit(0), PRE).first()) == (0, 0)


@pytest.fixture
def reader(spark, tmp_path):
    """Reader that lands one notice per job and day of its range start; bid jobs may fail."""

    def make(broken=(), title="t"):
        def read(pending):
            number = F.concat(F.col("mode"), F.col("chunk_begin").cast("string"), "business_type")
            field = F.when(F.col("mode") == "pre", "bfSpecRgstNo").otherwise("bidNtceNo")
            published = F.when(F.col("mode") == "pre", "rgstDt").otherwise("bidNtceDt")
            item = F.create_map(field, number, published, F.col("chunk_begin").cast("string"), F.lit("bidNtceNm"), F.lit(title), F.lit("prdctClsfcNoNm"), F.lit(title))
            error = F.when(F.col("mode").isin(list(broken)), F.lit("denied"))
            return pending.select(
                "job_id", "business_type", F.lit(0).alias("job_ix"), F.lit(1).alias("page"), F.lit(0).alias("item_ix"),
                F.when(error.isNull(), item).alias("item"), error.alias("error"),
            )

        return read

    return make


def test_collect_then_browse(spark, tmp_path, reader):
    config = collect_config({"begin": "2024-01-01", "end": "2024-02-10", "businessTypes": ["용역", "공사"]}, date(2024, 3, 1))
    plan = programs.collect_plan(spark, config)
    assert plan.count() == 2 * 2 * 2
    store = NoticeStore(spark, str(tmp_path / "store"))
    failed, _ = programs.collect(store, plan, reader(broken=["bid"]))
    assert failed.count() == 4 and store.read().count() == 4
    # the failed jobs are still pending, the others are not read again
    failed, _ = programs.collect(store, plan, reader(title="second"))
    assert failed.count() == 0 and store.read().count() == 8
    found = programs.browse(store, date(2024, 1, 1), date(2024, 1, 20), query="SECOND")
    assert [r["mode"] for r in found.collect()] == ["bid", "bid"]
    analyses = spark.createDataFrame([("bid", "bid2024-01-29용역", 3, True)], "mode string, number string, item_count int, verified boolean")
    page = programs.browse(store, date(2024, 1, 1), date(2024, 2, 10), mode="bid", business_type="용역", analyses=analyses).collect()
    assert [(r["number"], r["verified"]) for r in page] == [("bid2024-01-29용역", True), ("bid2024-01-01용역", None)]
    # reading everything again replaces what the jobs cover
    programs.collect(store, plan.where("business_type = '용역'"), reader(title="third"), resume=False)
    titles = [r[0] for r in store.read().select(F.col("item")["bidNtceNm"]).collect()]
    assert sorted(titles) == ["second", "second", "t", "t", "third", "third", "third", "third"]


def test_downloads(spark):
    records = spark.createDataFrame(
        [
            (0, {"bidNtceNo": "1", "dminsttNm": "국민연금공단", "bidNtceDt": "2024-01-01", "ntceSpecDocUrl1": "https://h/1", "ntceSpecFileNm1": "제안요청서.hwp"}),
            (1, {"bidNtceNo": "1", "dminsttNm": "국민연금공단", "bidNtceDt": "2024-01-05", "ntceSpecDocUrl1": "https://h/0", "ntceSpecFileNm1": "x.pdf", "ntceSpecDocUrl2": "https://h/2", "ntceSpecFileNm2": "제안요청서/v2.hwp"}),
            (2, {"bidNtceNo": "2", "dminsttNm": "시청", "bidNtceDt": "2024-02-01", "ntceSpecDocUrl1": "https://h/3", "ntceSpecFileNm1": "제안요청서.hwp"}),
            (3, {"dminsttNm": "국민연금공단"}),
        ],
        "arrival int, item map<string,string>",
    )
    listed = programs.downloads(records, BID, ("연금",), "제안요청서", limit=50).collect()
    assert [(r["number"], r["slot"], r["url"], r["target"]) for r in listed] == [("1", 1, "https://h/2", "01_v2.hwp")]


def test_verified_results(spark):
    detail = "서버 CPU와 메모리 요구사항 및 장애 대응 방안을 제안서에 충실하게 기술하여야 한다."
    good = {"requirements": [{"id": "ECR-1"}], "ecr": [{"id": "ECR-1", "detail": detail}]}
    responses = spark.createDataFrame([("n1", json.dumps(good)), ("n2", "{broken")], "notice string, raw string")
    sources = spark.createDataFrame([("n1", "ECR-1 " + detail)], "notice string, markdown string")
    made, failed = programs.verified_results(responses, sources, ["notice"])
    assert [(r["notice"], r["verification"]["verified"]) for r in made.collect()] == [("n1", True)]
    assert [(r["notice"], r["raw"]) for r in failed.collect()] == [("n2", "{broken")]


def test_quote_of_the_second_document_is_verified(spark):
    detail = "The supplier shall keep the servers of both sites in step and report every gap within an hour."
    answer = {"requirements": [{"id": "ECR-1"}], "ecr": [{"id": "ECR-1", "detail": detail}]}
    responses = spark.createDataFrame([("n1", json.dumps(answer))], "notice string, raw string")
    sources = spark.createDataFrame(
        [("n1", "02", "ECR-1 " + detail), ("n1", "01", "cover page")], "notice string, sequence string, markdown string"
    )
    made, _ = programs.verified_results(responses, sources, ["notice"])
    assert [r["verification"]["verified"] for r in made.collect()] == [True]


def test_browse_of_an_empty_store(spark, tmp_path):
    store = NoticeStore(spark, str(tmp_path / "none"))
    assert programs.browse(store, date(2024, 1, 1), date(2024, 12, 31)).count() == 0
