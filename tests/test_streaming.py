from datetime import datetime

from noticeflow.streaming import streams

SCHEMA = "key string, ts timestamp, arrival int, copy string"


def day(n):
    return datetime(2024, 1, n)


def test_first_arrivals_of_many_keys_in_few_states(spark, tmp_path):
    """Copies in one micro-batch and in later ones; blank keys, rows without a time, late rows and forgotten keys."""
    batches = [
        [(f"k{i}", day(1), 5, "later") for i in range(300)] + [(f"k{i}", day(1), 2, "first") for i in range(300)]
        + [(None, day(1), 1, "null"), (None, day(1), 1, "null"), ("", day(1), 1, "blank"), ("old", None, 9, "a"), ("old", None, 3, "b")],
        [(f"k{i}", day(2), 1, "again") for i in range(310)] + [("old", None, 1, "c"), ("", None, 1, "blank")],
        [("new", day(20), 1, "far")],
        [("late", day(2), 0, "late"), ("late", day(19), 4, "in time"), ("new", day(20), 0, "again"), ("k0", day(18), 1, "within")],
        [("end", day(28), 1, "far")],
        [("k0", day(27), 1, "forgotten"), ("new", day(25), 1, "still known")],
    ]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    first = streams.stream_keep_first(arriving, "key", "ts", "5 days", ["arrival", "copy"], buckets=8)
    query = (
        first.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()
    got = sorted((r.key or "", r.copy) for r in out)
    want = [(f"k{i}", "first") for i in range(300)] + [(f"k{i}", "again") for i in range(300, 310)]
    want += [("", "null"), ("", "null"), ("", "blank"), ("", "blank"), ("old", "b"), ("new", "far"), ("end", "far")]
    # Spark drops rows as late one micro-batch after the watermark has passed them
    want += [("late", "late"), ("k0", "forgotten")]
    assert got == sorted(want)
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 8
