import gzip
import json
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeflow.functions.dates import record_day
from noticeflow.operators.sets import union_columns
from noticeflow.sources import daily_csv, envelope, landed
from noticeflow.sources.paged_rest import paged_rest_source, read_jobs
from noticeflow.sources.store import NoticeStore, complete_jobs, completed_jobs
from noticeflow.streaming import streams

# ---- envelopes


def body(items, **more):
    return json.dumps({"response": {"header": {"resultMsg": "OK"}, "body": {"items": items, **more}}}, ensure_ascii=False)


@pytest.mark.parametrize(
    "items, numbers",
    [
        ([{"no": "1"}, {"no": 2, "n": {"a": [1]}}], ["1", "2"]),
        ({"item": [{"no": "1"}, {"no": "2"}]}, ["1", "2"]),
        ({"item": {"no": "1"}}, ["1"]),
        (None, []),
        ({}, []),
        ("", []),
        ([], []),
    ],
)
def test_item_shapes(one, items, numbers):
    found = one(envelope.envelope_items(F.lit(body(items))))
    assert [i["no"] for i in found] == numbers


def test_nested_values_stay_json(one):
    item = one(envelope.envelope_items(F.lit(body([{"n": {"a": [1, "가"]}, "z": None}]))))[0]
    assert json.loads(item["n"]) == {"a": [1, "가"]} and item["z"] is None


@pytest.mark.parametrize(
    "status, text, kind",
    [
        (200, body([]), "ok"),
        (429, body([]), "transient"),
        (504, "", "transient"),
        (200, '{"error":"x","upstreamStatus":504}', "transient"),
        (200, '{"error":"x","upstreamStatus":"429"}', "transient"),
        (200, "<xml>기간</xml>", "transient"),
        (200, '{"response":{"header":{"resultMsg":"조회기간 초과"}}}', "range_error"),
        (200, '{"response":{"header":{"resultMsg":"out of Range"}}}', "range_error"),
        (200, '{"response":{"header":{"resultMsg":"no key"}}}', "error"),
        (200, '{"broken', "error"),
    ],
)
def test_classes(one, status, text, kind):
    assert one(envelope.classify(F.lit(status), F.lit(text))) == kind


def test_messages(one):
    assert one(envelope.message(F.lit("<" + "x" * 500))) == "<" + "x" * 399
    assert one(envelope.message(F.lit('{"a":1}'))) == '{"a":1}'


# ---- paged source


@pytest.mark.parametrize("partial, kept", [("keep", 2), ("drop", 0)])
def test_paged_source(spark, partial, kept):
    def fixture_fetch(job, page):
        if job["type"] == "broken" and page == 2:
            return 200, '{"response":{"header":{"resultMsg":"denied"}}}'
        if job["type"] == "busy":
            return 503, "{}"
        first = (page - 1) * 2
        items = [{"no": f"{job['type']}{i}", "n": {"a": i}} for i in range(first, min(first + 2, 5))]
        return 200, json.dumps({"response": {"body": {"items": items, "totalCount": "5", "numOfRows": "2"}}})

    jobs = [{"type": "a"}, {"type": "broken"}, {"type": "busy"}]
    spark.dataSource.register(paged_rest_source(fixture_fetch, sleep=lambda seconds: None))
    assert spark.read.format("paged_rest").options(jobs=json.dumps(jobs)).load().rdd.getNumPartitions() == 3
    rows = read_jobs(spark, jobs, keep_partial=partial == "keep").collect()
    items = [(r["job_ix"], r["page"], r["item_ix"], r["item"]["no"]) for r in rows if r["error"] is None]
    assert [i for i in items if i[0] == 0] == [
        (0, 1, 0, "a0"), (0, 1, 1, "a1"), (0, 2, 0, "a2"), (0, 2, 1, "a3"), (0, 3, 0, "a4"),
    ]
    assert len([i for i in items if i[0] == 1]) == kept
    assert {r["job_ix"]: r["error"] for r in rows if r["error"]} == {1: "denied", 2: "{}"}


def test_any_body_of_another_form_is_an_error_row(spark):
    bodies = {
        "list": "[1, 2]", "total": body([{"a": 1}], totalCount="n/a"), "items": body("none"), "item": body(["x"]), "response": '{"response":[1]}',
        "inner": '{"response":{"body":[1]}}', "upstream": '{"upstreamStatus":"soon"}', "number": "3", "good": body([{"a": [1]}]),
    }

    spark.dataSource.register(paged_rest_source(lambda job, page: (200, bodies[job["kind"]]), name="odd_bodies", sleep=lambda seconds: None))
    jobs = [{"kind": k} for k in bodies]
    rows = {json.loads(r["job_id"])["kind"]: r for r in read_jobs(spark, jobs, source="odd_bodies").collect()}
    assert set(rows) == set(bodies)
    assert rows.pop("good")["item"] == {"a": "[1]"} and all(r["error"] and r["item"] is None for r in rows.values())
    assert "n/a" in rows["total"]["error"]


def test_filters_choose_the_jobs_that_are_read(spark):
    answers = [body([{"n": i}]) for i in range(9)]

    def fetch(job, page):
        if job["n"] not in (2, 5):
            raise RuntimeError("not asked for")
        return 200, answers[job["n"]]

    spark.dataSource.register(paged_rest_source(fetch, name="counted"))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("counted").options(jobs=json.dumps([{"n": i} for i in range(9)]), pushdown="true").load()
        assert [r["item"]["n"] for r in read.where("job_ix IN (2, 5) AND page = 1").collect()] == ["2", "5"]
        assert read.where("job_id = 'none'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


# ---- CSV


def test_open_schema_becomes_text(spark, tmp_path):
    a = spark.createDataFrame([("first", (1,), "7")], "common string, nested struct<sequence:int>, id string")
    b = spark.createDataFrame([("second", ["a", "b"])], "common string, onlySecond array<string>")
    daily_csv.write_daily(a, str(tmp_path / "a"))
    daily_csv.write_daily(b, str(tmp_path / "b"))
    both = daily_csv.read_daily(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert set(both.columns) == {"common", "nested", "id", "onlySecond"}
    rows = {r["common"]: r for r in both.collect()}
    assert rows["first"]["nested"] == '{"sequence":1}' and rows["first"]["onlySecond"] == ""
    assert rows["second"]["onlySecond"] == '["a","b"]' and rows["second"]["id"] == ""


def test_bytes_of_a_file(spark, tmp_path):
    df = spark.createDataFrame([("교복(하복, 동복)", "", 'he "x"')], "a string, b string, c string")
    daily_csv.write_daily(df.coalesce(1), str(tmp_path / "out"))
    [part] = (tmp_path / "out").glob("part-*.csv.gz")
    assert gzip.decompress(part.read_bytes()).decode() == 'a,b,c\n"=""교복(하복, 동복)""",,"=""he ""x"""""\n'


def test_reads_foreign_files(spark, tmp_path):
    path = tmp_path / "bid" / "2024" / "01" / "02.csv.gz"
    path.parent.mkdir(parents=True)
    path.write_bytes(gzip.compress('\ufeffa,b\r\n="=""x""",=00123\r\n,\r\nshort\r\n'.encode()))
    (tmp_path / "bid" / "2024" / "01" / "notes.csv.gz").write_bytes(gzip.compress(b"a\n1\n"))
    listed = daily_csv.list_partitions(spark, str(tmp_path), begin="2024-01-01", end="2024-01-31", mode="bid")
    [row] = listed.collect()
    assert (row["mode"], row["day"]) == ("bid", "2024-01-02")
    assert daily_csv.list_partitions(spark, str(tmp_path), begin="2024-02-01").count() == 0
    read = daily_csv.read_daily(spark, row["path"])
    assert read.columns == ["a", "b"]
    assert [tuple(r) for r in read.collect()] == [('=""x""', "00123"), ("short", "")]


def test_cells_go_by_the_names_in_their_own_header(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\na1,b1\n")
    (tmp_path / "two.csv").write_text('\ufeffb,"c, d",a\n"=""b\n2""",c2,a2\n')
    (tmp_path / "empty.csv").write_text("")
    read = daily_csv.read_daily(spark, str(tmp_path))
    assert sorted((r["a"], r["b"], r["c, d"]) for r in read.collect()) == [("a1", "b1", ""), ("a2", "b\n2", "c2")]


def test_daily_files_in_their_layout(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame(
        [("bid", "2024-01-05", 2, {"b": "2", "c": ""}), ("bid", "2024-01-05", 1, {"a": 'x"\n,', "b": "007"}), ("pre", "2024-02-01", 3, {"z": "1"})],
        "mode string, day string, o int, item map<string,string>",
    )
    daily_csv.write_daily_files(rows, root, ["o"])
    [file] = (tmp_path / "store" / "bid" / "2024" / "01").glob("*.gz")
    assert file.name == "05.csv.gz"
    assert gzip.decompress(file.read_bytes()).decode() == '\ufeffa,b,c\n"=""x""\n,""","=""007""",\n,"=""2""",\n'
    daily_csv.write_daily_files(rows.where("mode = 'pre'").withColumn("item", F.create_map(F.lit("y"), F.lit("2"))), root, ["o"])
    listed = daily_csv.list_partitions(spark, root).collect()
    assert [(r["mode"], r["day"]) for r in listed] == [("bid", "2024-01-05"), ("pre", "2024-02-01")]
    assert daily_csv.list_partitions(spark, root, begin="2024-01-06").count() == 1
    assert daily_csv.list_partitions(spark, root, end="2024-01-05", begin="2023-11-01").count() == 1
    back = daily_csv.read_daily(spark, [r["path"] for r in listed]).orderBy("b").collect()
    assert [(r["a"], r["b"], r["c"], r["y"]) for r in back] == [("", "", "", "2"), ('x"\n,', "007", "", ""), ("", "2", "", "")]
    assert not list((tmp_path / "store").glob("_staging*"))


texts = st.text(st.characters(codec="utf-8", exclude_characters="\r\x00", exclude_categories=["Cs"]), max_size=20)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=40))
def test_roundtrip(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("csv") / "out")
    numbered = [(str(i), a, b) for i, (a, b) in enumerate(rows)]
    daily_csv.write_daily(spark.createDataFrame(numbered, "i string, a string, b string"), path)
    back = daily_csv.read_daily(spark, path).collect()
    assert sorted(map(tuple, back), key=lambda r: int(r[0])) == numbered


def test_report_parts_are_in_order(spark, tmp_path):
    df = spark.range(100).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("number"), F.lit("a,b").alias("title"))
    lines = daily_csv.export_lines(df, ["number", "title"])
    daily_csv.write_report(lines, ["번호", "제목"], str(tmp_path / "r"), "number")
    header = "".join(f.read_text("utf-8") for f in sorted((tmp_path / "r" / "header").glob("part-*")))
    body_text = "".join(f.read_text("utf-8") for f in sorted((tmp_path / "r" / "rows").glob("part-*")))
    assert header == "\ufeff번호,제목\n"
    assert body_text.splitlines() == [f'{i:03d},"a,b"' for i in range(100)]


def test_fetch_check(one):
    check = lambda s, t, n: one(landed.fetch_check(F.lit(s), F.lit(t), F.lit(n)))
    assert check(200, "application/pdf", 5) is None
    assert check(404, "application/pdf", 5) == "HTTP 404"
    assert check(200, "TEXT/html;x", 5) == "html"
    assert check(200, "text/htmlx", 5) is None
    assert check(200, None, 0) == "empty"


# ---- store

SCHEMA = "key string, mode string, day string, seq long, business_type string, v string"


def make(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def stored(store, *columns):
    return sorted(tuple(r) for r in store.read().select(*(columns or ("key", "day", "v"))).collect())


@pytest.fixture
def store(spark, tmp_path):
    store = NoticeStore(spark, str(tmp_path / "store"))
    store.upsert(
        make(
            spark,
            ("bid:1", "bid", "2024-01-01", 1, "a", "one"),
            ("bid:2", "bid", "2024-01-02", 2, "a", "two"),
            ("bid:3", "bid", "2024-01-02", 3, "b", "three"),
        )
    )
    return store


def test_key_leaves_its_old_day(spark, store):
    store.upsert(make(spark, ("bid:1", "bid", "2024-01-03", 4, "a", "moved"), ("bid:1", "bid", "2024-01-02", 3, "a", "older")))
    assert stored(store) == [("bid:1", "2024-01-03", "moved"), ("bid:2", "2024-01-02", "two"), ("bid:3", "2024-01-02", "three")]
    index = [tuple(r) for r in store.daily_index().select("date", "count").collect()]
    assert index == [("2024-01-02", 2), ("2024-01-03", 1)]  # the emptied day is gone
    assert store.read_latest(1).count() == 1 and store.read_latest(2, "bid").count() == 3
    assert store.read(begin="2024-01-03").count() == 1 and store.read(mode="pre").count() == 0


def test_untouched_days_are_not_rewritten(spark, store):
    def files(day):
        return {f.name for f in Path(store.root).glob(f"data/p_mode=bid/p_day={day}/*.parquet")}

    before = files("2024-01-02")
    store.upsert(make(spark, ("bid:1", "bid", "2024-01-03", 4, "a", "moved")))
    assert before and files("2024-01-02") == before and files("2024-01-03") and not files("2024-01-01")
    assert not list(Path(store.root).glob("staging/*"))


def test_upsert_twice_is_upsert_once(spark, store):
    changes = make(spark, ("bid:1", "bid", "2024-01-03", 4, "a", "x"), ("bid:9", "bid", "2024-01-01", 5, "a", "y"))
    store.upsert(changes)
    once = stored(store)
    store.upsert(changes)
    assert stored(store) == once


def test_late_change_does_not_win(spark, store):
    store.upsert(make(spark, ("bid:2", "bid", "2024-01-09", 1, "a", "late")))
    assert ("bid:2", "2024-01-02", "two") in stored(store)


def test_undated_change_is_a_dead_letter(spark, store):
    raw = spark.createDataFrame([("bid:1", "bid", "no date", 7), ("", "bid", "2024-01-01", 8)], "key string, mode string, date string, seq long")
    changes = raw.select("key", "mode", record_day("date").alias("day"), "seq", F.lit("a").alias("business_type"), F.lit("z").alias("v"))
    rejected = store.upsert(changes)
    assert sorted(r["key"] for r in rejected.collect()) == ["", "bid:1"]
    assert ("bid:1", "2024-01-01", "one") in stored(store)


def test_replace_scope(spark, store):
    fresh = make(spark, ("bid:4", "bid", "2024-01-02", 1, "a", "four"), ("bid:1", "bid", "2024-01-02", 1, "a", "again"))
    store.replace_scope(fresh, "bid", "2024-01-01", "2024-01-02", F.col("business_type") == "a")
    assert stored(store) == [("bid:1", "2024-01-02", "again"), ("bid:3", "2024-01-02", "three"), ("bid:4", "2024-01-02", "four")]


@pytest.mark.parametrize("placed", [False, True])
def test_a_run_that_died_can_be_repeated(spark, store, monkeypatch, placed):
    """Before any partition was placed, or after the new ones were but the old day of a moved key was still there."""
    changes = make(spark, ("bid:1", "bid", "2024-01-03", 4, "a", "x"))
    place = NoticeStore._place

    def dies(self, rows, staging, places):
        if placed:
            place(self, rows, staging, [])
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(NoticeStore, "_place", dies)
        with pytest.raises(OSError):
            store.upsert(changes, 1, "s")
    store.upsert(changes, 1, "s")
    assert stored(store) == [("bid:1", "2024-01-03", "x"), ("bid:2", "2024-01-02", "two"), ("bid:3", "2024-01-02", "three")]


def test_new_columns_and_compaction(spark, store):
    wider = make(spark, ("bid:6", "bid", "2024-01-02", 9, "a", "six")).withColumn("extra", F.lit("e"))
    store.upsert(wider)
    assert sorted((r["key"], r["extra"]) for r in store.read().collect())[-1] == ("bid:6", "e")
    store.compact(day=F.lit("2024-02-01"))
    assert [tuple(r) for r in store.daily_index().select("date", "count").collect()] == [("2024-02-01", 4)]
    assert store.read().count() == 4


def test_streams_have_batches_of_their_own(spark, store):
    one, two = make(spark, ("bid:7", "bid", "2024-01-05", 9, "a", "x")), make(spark, ("bid:8", "bid", "2024-01-05", 9, "a", "y"))
    store.upsert(one, 5, "first")
    store.upsert(two, 0, "second")
    store.upsert(make(spark, ("bid:8", "bid", "2024-01-05", 10, "a", "again")), 0, "second")
    assert {("bid:7", "2024-01-05", "x"), ("bid:8", "2024-01-05", "y")} <= set(stored(store))


def test_modes_that_make_no_plain_path(spark, store):
    odd = make(spark, ("bid:7", "a:b", "2024-01-05", 9, "a", "x"), ("bid:8", None, "2024-01-05", 9, "a", "y"), ("bid:9", "c/d=e", "2024-01-05", 9, "a", "z"))
    store.upsert(odd)
    store.upsert(make(spark, ("bid:8", "bid", "2024-01-06", 10, "a", "moved")))
    assert {("bid:7", "2024-01-05", "x"), ("bid:8", "2024-01-06", "moved"), ("bid:9", "2024-01-05", "z")} <= set(stored(store))
    assert store.read().count() == 6


def test_jobs_follow_data(spark, tmp_path):
    schema = "job_id string"
    assert completed_jobs(spark, str(tmp_path), schema).count() == 0
    complete_jobs(spark, str(tmp_path), spark.createDataFrame([("a",)], schema))
    complete_jobs(spark, str(tmp_path), spark.createDataFrame([("a",), ("b",)], schema))
    assert sorted(r[0] for r in completed_jobs(spark, str(tmp_path), schema).collect()) == ["a", "b"]


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_batch(spark, tmp_path, files):
    rows = [(f"bid:{i % 7}", "bid", f"2024-01-{1 + i % 11:02d}", i, "a", str(i)) for i in range(60)]
    rows += [("bid:x", "bid", "undated", 99, "a", "x")]
    changes = make(spark, *rows)
    changes.repartition(files, F.hash("seq")).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "stream")
    for _ in range(2):  # a restart finds nothing new
        streams.stream_upsert(arriving, root, str(tmp_path / "cp"), dead_letter=str(tmp_path / "dead")).awaitTermination()
    batch = NoticeStore(spark, str(tmp_path / "batch"))
    batch.upsert(changes)
    assert stored(NoticeStore(spark, root)) == stored(batch)
    dead = spark.read.option("recursiveFileLookup", True).schema(changes.schema).parquet(str(tmp_path / "dead"))
    assert [r["key"] for r in dead.collect()] == ["bid:x"]


def test_repeated_micro_batch_is_skipped(spark, store):
    store.upsert(make(spark, ("bid:7", "bid", "2024-01-01", 9, "a", "seven")), batch_id=3)
    assert store.upsert(make(spark, ("bid:7", "bid", "2024-01-02", 10, "a", "again")), batch_id=3).count() == 0
    assert ("bid:7", "2024-01-01", "seven") in stored(store)


def test_union_needs_no_order(spark):
    assert union_columns(spark.createDataFrame([("1",)], "a string")).first()["a"] == "1"
