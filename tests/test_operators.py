import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.operators import dedup, excerpts, extraction, notices, positions, sets
from noticeflow.plans import config, jobs
from noticeflow.spec import BID, PRE, EXTRACTION


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---- dedup


def test_keep_first_before_filter(spark):
    df = spark.createDataFrame(
        [("1", 0, "skip"), ("1", 1, "hit"), ("", 2, "hit"), ("", 3, "hit"), ("2", 4, "hit")],
        "number string, seq int, title string",
    )
    first = dedup.keep_first(df, "number", "seq", copies="copies")
    found = notices.match_filters(first, {"title": "H I T"})
    # the filtered-out first copy still hides the later one; blank numbers are not compared
    assert rows(found, "number", "seq", "copies") == [("", 2, 0), ("", 3, 0), ("2", 4, 0)]
    assert rows(first.where("number = '1'"), "seq", "copies") == [(0, 1)]
    dropped = dedup.keep_first(df, "number", "seq", blank_key="drop")
    assert rows(dropped, "number", "seq") == [("1", 0), ("2", 4)]
    total = first.agg(F.count("*") + F.sum("copies")).first()[0]
    assert total == df.count()


def test_latest_is_stable_on_ties(spark):
    df = spark.createDataFrame([("a", "2024", 1), ("a", "2024", 0), ("a", "2023", 2)], "k string, d string, seq int")
    assert rows(dedup.latest_per_key(df, "k", "d", "seq"), "k", "d", "seq") == [("a", "2024", 0)]


def test_last_write_keeps_first_position(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 9, "y"), ("b", 5, "z")], "k string, seq int, v string")
    assert rows(dedup.last_write_wins(df, "k", "seq", "first"), "k", "v", "first") == [("a", "y", 3), ("b", "z", 5)]


# ---- positions: the path for large groups gives what a window gives


@pytest.fixture
def skewed(spark):
    """One group holds two thirds of all rows; another key is null."""
    return spark.range(900).select(
        F.when(F.col("id") < 600, "hot").when(F.col("id") < 620, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"),
        ((F.col("id") * 7919) % 900).alias("o"),
        (1 + F.col("id") % 4).alias("v"),
    )


@pytest.mark.parametrize("before", [False, True])
def test_large_groups(skewed, before):
    plain = positions.running(skewed, ["g"], ["o"], "n", F.col("v"), before)
    split = positions.running(skewed, ["g"], ["o"], "n", F.col("v"), before)
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, plain.collect()), key=key) == sorted(map(tuple, split.collect()), key=key)


def test_whole_table_positions(skewed):
    numbered = positions.running(skewed, [], ["o"], "n").select("o", "n").collect()
    assert all(r["n"] == r["o"] + 1 for r in numbered)


def test_deep_page(spark):
    df = spark.range(25_000).withColumnRenamed("id", "number")
    page = positions.page(df, ["number"], number=300, size=50)
    assert [r["number"] for r in page.collect()] == list(range(14_950, 15_000))
    last = positions.page(df, ["number"], number=9_999, size=50, descending=["number"])
    assert [r["number"] for r in last.collect()] == list(range(49, -1, -1))
    empty = positions.page(df.where("number < 0"), ["number"], number=3)
    assert empty.count() == 0


@pytest.mark.parametrize("head", [10_000, 40])
def test_pages_of_any_depth_hold_the_rows_in_order(spark, head):
    values = [(i % 7 if i % 11 else None, f"k{i % 50:02d}" if i % 13 else None, i) for i in range(600)]
    df = spark.createDataFrame(values, "a int, b string, c int").repartition(5)

    def place(v):
        return (v[0] is None, -(v[0] or 0), v[1] is not None, v[1] or "", v[2])

    ordered = sorted(values, key=place)
    for number in (1, 2, 9, 30, 31, 99):
        shown = positions.page(df, ["a", "b", "c"], number, size=20, descending=["a"], head=head)
        first = (min(number, 30) - 1) * 20
        assert [(r["a"], r["b"], r["c"]) for r in shown.collect()] == ordered[first : first + 20]
        assert {(r["page"], r["pages"]) for r in shown.collect()} == {(min(number, 30), 30)}


def test_page_of_equal_keys(spark):
    df = spark.range(500).select("id", F.lit(1).alias("same"))
    assert positions.page(df, ["same"], number=4, size=50, head=40).count() == 50



def test_chunks_of_a_hot_group(skewed):
    chunks = positions.chunk_ids(skewed.where("g is not null"), ["g"], ["o"], "o", 7)
    assert chunks.agg(F.max(F.size("ids"))).first()[0] == 7
    assert chunks.agg(F.sum(F.size("ids"))).first()[0] == 880
    firsts = chunks.where("g = 'hot'").orderBy("chunk").select("ids").collect()
    merged = [i for r in firsts for i in r["ids"]]
    assert merged == sorted(merged) and len(merged) == 600


# ---- notices


def test_attachments(spark):
    record = {f"specDocFileUrl{i}": None for i in range(1, 6)} | {
        "bfSpecRgstNo": " 7 ",
        "specDocFileUrl1": " https://h/a.hwp ",
        "specDocFileUrl2": "https://h/a.hwp",
        "specDocFileUrl3": "ftp://h/b",
        "specDocFileUrl4": "https://h/view",
    }
    df = spark.createDataFrame([(record,)], "item map<string,string>")
    row = notices.map_notice(df, PRE).first()
    assert row["number"] == "7"
    assert [(f["url"], f["name"]) for f in row["files"]] == [
        ("https://h/a.hwp", "a.hwp"),
        ("https://h/view", "첨부파일 2"),  # numbered among those kept
    ]
    tender = {"bidNtceNo": "1", "ntceSpecDocUrl3": "https://h/c", "ntceSpecDocUrl5": "https://h/d", "ntceSpecFileNm5": "d.pdf"}
    row = notices.map_notice(spark.createDataFrame([(tender,)], "item map<string,string>"), BID).first()
    assert [f["name"] for f in row["files"]] == ["첨부파일 3", "d.pdf"]  # numbered by slot


def test_record_with_both_numbers(spark):
    df = spark.createDataFrame([("T1", "P1"), ("", "P2"), ("", "")], "bidNtceNo string, bfSpecRgstNo string")
    read = notices.field_reader(df)
    assert [r[0] for r in df.select(notices.record_key(read)).collect()] == ["bid:T1", "pre:P2", ""]


def test_limit_comes_before_attachment_filter(spark):
    files = F.array(F.struct(F.lit("u").alias("url"), F.concat(F.lit("n."), "ext").alias("name"), F.lit(1).alias("slot")))
    df = spark.createDataFrame([(1, "2024", "hwp"), (2, "2025", "pdf"), (3, "", "hwp")], "number int, day string, ext string")
    picked = notices.select_attachments(df.withColumn("files", files), 1, r"\.HWP$", "day", "number")
    assert picked.count() == 0  # the newest one has no match
    ordered = notices.newest_first(df, "day", "number")
    assert [r["number"] for r in ordered.collect()] == [2, 1, 3]


def test_filters(spark):
    df = spark.createDataFrame([("국민 건강", "C1"), ("시청", "C2")], "institution string, institution_code string")
    assert notices.institution_any(df, []).count() == 2
    assert notices.institution_any(df, ["건강", "x"]).count() == 1
    assert notices.institution_any(df, ["건강"], ["C2"]).first()["institution"] == "시청"
    assert notices.match_filters(df, {"institution": " 국 민건"}).count() == 1
    assert notices.optional_equals(df, institution="").count() == 2
    assert notices.drop_columns(df, ["institution", "absent"]).columns == ["institution_code"]


# ---- plans


def test_date_chunks_cover_each_day_once(spark):
    for days in (1, 28, 30):
        chunks = jobs.date_chunks(spark, date(2024, 1, 1), date(2024, 4, 3), days).collect()
        covered = [d for c in chunks for d in range(c["chunk_begin"].toordinal(), c["chunk_end"].toordinal() + 1)]
        assert covered == list(range(date(2024, 1, 1).toordinal(), date(2024, 4, 3).toordinal() + 1))


@pytest.mark.parametrize("total, pages", [(None, 1), (0, 1), (999, 1), (1000, 2)])
def test_page_count(one, total, pages):
    assert one(jobs.page_count(F.lit(total).cast("long"))) == pages


def test_adaptive_reading(spark):
    """Ranges over ten days fail in one mode, over twenty in the other; everything is read in the end, once."""
    modes = spark.createDataFrame([("bid",), ("pre",), (None,)], "mode string")
    plan = jobs.date_chunks(spark, date(2024, 1, 1), date(2024, 2, 29), 30).crossJoin(modes)
    limit = F.when(F.col("mode") == "bid", 10).otherwise(20)

    def read(pending):
        span = F.datediff("chunk_end", "chunk_begin") + 1
        status = F.when(span > limit, "range_error").when((F.day("chunk_begin") == 15) & (F.col("mode") == "bid"), "error").otherwise("ok")
        days = F.explode(F.sequence(F.col("chunk_begin"), F.col("chunk_end"))).alias("day")
        error = F.when(F.col("status") != "ok", F.concat_ws(" ", "status", "chunk_begin"))
        # a failed range brings part of its days
        return pending.withColumn("status", status).select("*", error.alias("error"), days).where("status = 'ok' OR day < chunk_begin + 3")

    landed, outcome, learned = jobs.read_adaptive(plan, read, learn_by=["mode"])
    assert landed.count() == landed.select("mode", "day").distinct().count()
    read_days = {r["mode"]: r["n"] for r in landed.where("status = 'ok'").groupBy("mode").agg(F.count("*").alias("n")).collect()}
    failed = landed.where("status = 'error'").select(F.datediff("chunk_end", "chunk_begin") + 1).distinct().collect()
    assert read_days["pre"] == read_days[None] == 60 and read_days["bid"] == 60 - sum(r[0] for r in failed)
    assert {(r["mode"], r["learned_days"]) for r in learned.collect()} == {("bid", 7), ("pre", 14), (None, 14)}
    got = {(r["mode"], r["root_begin"].day): (r["error"], r["pieces"]) for r in outcome.collect()}
    assert got["pre", 1] == (None, 3) and got["bid", 1] == ("error 2024-01-15", 5)
    again = jobs.learned_chunks(plan.where("mode = 'bid' AND chunk = 0").select("mode", "chunk_begin", "chunk_end").toDF("mode", "b", "e"),
                                learned, "b", "e", 30, ["mode"]).collect()
    assert len(again) == 5 and again[-1]["chunk_end"] == date(2024, 1, 30) and (again[0]["chunk_end"] - again[0]["chunk_begin"]).days == 6


def test_split_stops(spark):
    plan = jobs.date_chunks(spark, date(2024, 1, 1), date(2024, 1, 1), 30).withColumn("depth", F.lit(0))
    assert jobs.split_ranges(plan, F.lit(True)).count() == 1
    deep = jobs.date_chunks(spark, date(2024, 1, 1), date(2024, 1, 30), 30).withColumn("depth", F.lit(6))
    assert jobs.split_ranges(deep, F.lit(True)).count() == 1
    landed, _, learned = jobs.read_adaptive(
        plan.drop("depth"), lambda p: p.withColumns({"status": F.lit("transient"), "error": F.lit("busy")})
    )
    assert landed.count() == 1 and learned.count() == 0


def test_resume_needs_the_current_version(spark):
    plan = spark.createDataFrame([("a", 2), ("b", 2)], "notice string, version int")
    done = spark.createDataFrame([("a", 2), ("b", 1)], "notice string, version int")
    assert rows(jobs.resume_pending(plan, done, ["notice", "version"]), "notice") == [("b",)]
    assert jobs.resume_pending(plan, done, ["notice", "version"], resume=False).count() == 2


def test_config():
    made = config.collect_config({"modes": ["본공고", "x"], "businessTypes": ["용역", "y"]}, date(2024, 1, 1))
    assert made.modes == ("bid",) and made.business_types == ("용역",) and made.resume
    assert made.begin == date(2015, 1, 1) and made.end == date(2024, 1, 1)
    with pytest.raises(ValueError):
        config.collect_config({"begin": "2025-01-01"}, date(2024, 1, 1))


# ---- sets


def test_union_and_differences(spark):
    a = spark.createDataFrame([("1", "x")], "id string, a string")
    b = spark.createDataFrame([("2", "y")], "id string, b string")
    both = sets.union_columns(a, b)
    assert both.columns == ["id", "a", "b"]
    assert rows(both, "id", "a", "b") == [("1", "x", ""), ("2", "", "y")]


def test_stored_names_come_before_names_from_addresses(spark):
    url = "https://x.example/get.do?fileNm=%EA%B0%80.hwp"
    raw = spark.createDataFrame([("1", url, "kept.hwp", url + "2", ""), ("2", url, None, None, None)],
                                "bfSpecRgstNo string, specDocFileUrl1 string, specDocFileNm1 string, specDocFileUrl2 string, specDocFileNm2 string")
    mapped = notices.map_notice(raw, PRE).collect()
    assert {r["number"]: [f["name"] for f in r["files"]] for r in mapped} == {"1": ["kept.hwp", "가.hwp2"], "2": ["가.hwp"]}
    both = notices.map_records(raw, F.lit("pre"), attach=False)
    assert sorted(map(tuple, notices.with_files(both).select("number", "files").collect())) == sorted((r["number"], r["files"]) for r in mapped)


# ---- excerpts


def test_excerpts_anywhere(spark):
    base = "가나다 the quick brown fox jumps over the lazy dog \U0001f600 and runs on and on"
    texts = spark.createDataFrame(
        [(1, "x" * 100 + base), (2, base.replace(" ", "\n ")), (3, base.upper()), (4, ""), (5, "con" + base)],
        "doc int, text string",
    )
    quotes = spark.createDataFrame(
        [("hit", base), ("short", base[:39]), ("miss", "z" + base), ("upper", base.upper()), ("again", base[:40] + "other")],
        "id string, quote string",
    )
    found = excerpts.ground_excerpt(quotes, "quote", texts, "doc", "text")
    got = {r["id"]: (r["too_short"], r["found"], r["texts"], r["first_text"]) for r in found.collect()}
    assert got == {
        "hit": (False, True, 3, 1),
        "again": (False, True, 3, 1),
        "short": (True, False, 0, None),
        "miss": (False, False, 0, None),
        "upper": (False, True, 1, 3),
    }


def test_rolling_hash_matches_substrings():
    value = "abc가" * 30
    hashes = excerpts.window_hashes(value)
    assert len(hashes) == len(value) - 39
    assert all(hashes[i] == excerpts.window_hashes(value[i : i + 40])[0] for i in range(len(hashes)))


def test_filter_grows_with_the_excerpts_and_has_few_chance_hits(spark):
    assert excerpts.filter_bits(10) == excerpts.LEAST_BITS and excerpts.filter_bits(10**9) == excerpts.MOST_BITS
    for many in (100, 30_000):
        wanted = spark.range(many).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40).alias("excerpt"))
        made = excerpts.build_filter(wanted, excerpts.filter_bits(many))
        own = np.concatenate([excerpts.window_hashes(r[0]) for r in wanted.collect()])
        assert len(made.passed(own)) == many  # no wanted window is lost
        other = np.random.default_rng(many).integers(0, 2**64, 4_000_000, dtype=np.uint64)
        assert len(made.passed(other)) <= 4


def test_more_excerpts_than_a_filter_holds(spark):
    texts = spark.range(300).select("id", F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.sha2(F.lit("same"), 256)).alias("text"))
    wanted = spark.range(-4000, 4000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 5, 40).alias("excerpt"))
    wanted = wanted.union(spark.range(1).select(F.substring(F.sha2(F.lit("same"), 256), 20, 40)))
    found = excerpts.excerpt_hits(wanted, texts, "id", "text", most_bits=16)
    got = [(r["texts"], r["first_text"]) for r in found.collect()]
    assert sorted(got) == [*((1, i) for i in range(300)), (300, 0)]


# ---- extraction


def test_normalise_keys(one):
    raw = {
        "requirements": [{"reqNo": "ECR-1", "name": "n", "category": "c"}],
        "equipmentRequirements": [
            {"ID": "ECR-1", "details": "d", "specifications": [{"item": "cpu", "specification": "16"}],
             "파생규격": {"cpu": ""}, "derivedSpecs": {"cpu": "16", "other": "o"}, "deliverables": ["x"]}
        ],
        "requirementCount": 1,
    }
    made = one(extraction.normalise_keys(F.lit(json.dumps(raw, ensure_ascii=False))))
    item = made["ecr"][0]
    assert made["요구사항목록"][0]["ID"] == "ECR-1" and made["요구사항수"] == 1
    assert item["세부내용_원문"] == "d" and item["기본규격"][0]["요구사항"] == "16"
    assert item["파생규격"]["cpu"] == "16" and item["파생규격"]["기타"] == "o" and item["산출물"] == ["x"]
    assert made["누락"] == [] and made["사업개요"]["예산"] == ""
    assert one(extraction.normalise_keys(F.lit("{"))) is None


def test_normalised_result_conforms(spark):
    raw = json.dumps({"ecr": [{"id": "ECR-1", "기본규격": [{"수량": "1"}]}]}, ensure_ascii=False)
    df = spark.createDataFrame([(raw,)], "raw string")
    made = df.select(extraction.normalise_keys("raw").alias("r")).select(F.to_json("r").alias("j"))
    assert made.select(extraction.conforms("j")).first()[0] is True
    broken = made.select(F.replace("j", F.lit('"수량":"1"'), F.lit('"수량":1')).alias("j"))
    assert broken.select(extraction.conforms("j", EXTRACTION)).first()[0] is False


def test_build_items_keeps_all_in_parts(spark):
    df = spark.range(25).select(F.lit("d").alias("doc"), F.col("id").alias("pos"), F.col("id").cast("string").alias("v"))
    for options in ({},):
        built = extraction.build_items(df, ["doc"], ["pos"], ["v"], part_size=10, **options).orderBy("part").collect()
        assert [len(r["items"]) for r in built] == [10, 10, 5]
        assert [i["v"] for r in built for i in r["items"]] == [str(i) for i in range(25)]


def test_requests_and_merge(spark):
    documents = spark.createDataFrame([("d", "ECR-001 a ECR-002 b ECR-003 c")], "doc string, text string")
    planned = extraction.plan_requests(
        documents.withColumn("ids", F.array(*map(F.lit, ["ECR-001", "ECR-002", "ECR-003"]))), ["doc"], "text", "ids", 2
    ).orderBy("request").collect()
    assert [(r["kind"], r["ids"]) for r in planned] == [
        ("summary", []), ("details", ["ECR-001", "ECR-002"]), ("details", ["ECR-003"]),
    ]
    expected = spark.createDataFrame([("d", "ECR-001", 0), ("d", "ECR-002", 1), ("d", "ECR-003", 2)], "doc string, id string, pos int")
    answers = spark.createDataFrame(
        [("d", "ECR-001", 0, "old"), ("d", "ECR-001", 1, "new"), ("d", "", 1, "no id"), ("d", "ECR-009", 1, "other")],
        "doc string, id string, round int, body string",
    )
    merged = extraction.merge_responses(answers, expected, ["doc"], "id", ["round"]).orderBy("pos").collect()
    assert [(r["id"], r["body"], r["missing"]) for r in merged] == [
        ("ECR-001", "new", False), ("ECR-002", None, True), ("ECR-003", None, True),
    ]
    retry = extraction.retry_missing(documents, expected, answers, ["doc"], "id", attempt=0, size=2)
    assert retry.first()["ids"] == ["ECR-002", "ECR-003"]
    assert extraction.retry_missing(documents, expected, answers, ["doc"], "id", attempt=3) is None


def test_answers_are_asked_for_until_the_rounds_are_over(spark):
    text = "long " * 4000
    documents = spark.createDataFrame([("n", text), ("m", "m text"), ("empty", "x")], "doc string, text string")
    expected = spark.createDataFrame([("n", f"i{k}") for k in range(7)] * 2 + [("m", "i0"), ("m", "never")], "doc string, id string")
    seen = []

    def ask(requests, attempt):
        seen.append(sorted((r["doc"], r["request"], tuple(r["ids"]), len(r["source"])) for r in requests.collect()))
        asked = requests.select("doc", F.explode("ids").alias("id"))
        due = F.when(F.col("id") == "never", 9).otherwise(F.substring("id", 2, 1).cast("int") % 3)
        other = spark.createDataFrame([("m", "unasked"), ("m", None), ("m", "")], "doc string, id string")
        return asked.where(due <= attempt).unionByName(other).withColumn("body", F.lit(f"round {attempt}"))

    answers, ledger, missing = extraction.answer_rounds(documents, expected, ask, ["doc"], "id", size=3)
    assert [len(x) for x in seen] == [4, 3, 2, 1]
    assert all(n == (len(text) if doc == "n" else 6) for requests in seen for doc, _, _, n in requests)
    assert rows(missing, "doc", "id") == [("m", "never")]
    rounds = {(r["doc"], r["id"]): r["n"] for r in ledger.groupBy("doc", "id").agg(F.count("*").alias("n")).collect()}
    assert rounds == {("n", f"i{k}"): 1 + k % 3 for k in range(7)} | {("m", "i0"): 1, ("m", "never"): 4}
    merged = extraction.merge_responses(answers, expected.distinct(), ["doc"], "id", ["round"])
    assert merged.where("missing").count() == 1 and merged.where("body = 'round 2'").count() == 2


def test_requests_of_few_and_many_ids_are_the_same(spark):
    ids = [(k, f"i{n:03d}") for k, count in (("a", 1), ("b", 7), ("c", 25), (None, 4)) for n in range(count)] + [("b", None), ("d", None)]
    ids = spark.createDataFrame(ids, "doc string, id string")
    documents = spark.createDataFrame([(k, f"text {k}") for k in "abcdx"], "doc string, text string")
    found = [
        rows(extraction._requests(ids, documents, ["doc"], "id", 3, False, most=most), "doc", "request", "ids", "source") for most in (0, 5, 100)
    ]
    assert found[0] == found[1] == found[2]
    assert [r[1:3] for r in found[0] if r[0] == "b"] == [(0, ["i000", "i001"]), (1, ["i002", "i003", "i004"]), (2, ["i005", "i006"])]
    assert [len(r[2]) for r in found[0] if r[0] == "c"] == [3] * 8 + [1] and [r[2] for r in found[0] if r[0] == "d"] == [[]]


def test_requests_of_few_ids_take_no_range_partitioning(spark, monkeypatch):
    def running(*args, **options):
        raise AssertionError("numbered over ranges")

    monkeypatch.setattr(extraction, "running", running)
    ids = spark.createDataFrame([("a", "1"), ("a", "2")], "doc string, id string")
    documents = spark.createDataFrame([("a", "text")], "doc string, text string")
    assert extraction._requests(ids, documents, ["doc"], "id", 3, False).first()["ids"] == ["1", "2"]


def test_choose_ids(one):
    a, b = F.array(F.lit("1"), F.lit("2")), F.array(F.lit("3"))
    assert one(extraction.choose_ids(b, a)) == ["1", "2"]
    assert one(extraction.choose_ids(a, a)) == ["1", "2"]
    assert one(extraction.chunk_array(F.array().cast("array<string>"), 2)) == []
