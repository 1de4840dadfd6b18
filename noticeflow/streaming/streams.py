"""Structured Streaming forms of the keyed merge and of deduplication."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import hadoop_path
from ..sources.store import NoticeStore


def stream_upsert(
    changes: DataFrame,
    root: str,
    checkpoint: str,
    key: str = "key",
    order: str = "seq",
    dead_letter: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Merge arriving rows into the store at ``root``.

    The batch id is committed with the data under the id of the query, so a repeated micro-batch changes
    nothing, and streams with other checkpoints, old or new, write to the same store. Changes that cannot be
    placed go to ``dead_letter``, by default a folder of the store. The
    result does not depend on how the input is cut into files, because the arrival order
    column decides which copy of a key stays.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        stream = query_id(batch.sparkSession, checkpoint)
        rejected = NoticeStore(batch.sparkSession, root, key, order).upsert(batch, batch_id, stream)
        folder = dead_letter or f"{root}/dead_letter"
        rejected.write.mode("overwrite").parquet(f"{folder}/stream={stream}/batch={batch_id}")

    return (
        changes.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint; a new checkpoint has another one."""
    fs, path = hadoop_path(spark, f"{checkpoint}/metadata")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def stream_keep_first(
    changes: DataFrame, key: str, event_time: str, delay: str, order: Sequence[str] | None = None, buckets: int = 1024
) -> DataFrame:
    """The first arrival of each key: of the copies in one micro-batch the least by ``order`` (default: the event time, nulls
    first), and none in later ones. Rows with a blank key are never copies of each other and all pass.

    A key is remembered until the watermark is ``delay`` past its event time; a copy that comes later than that passes again, and rows older than
    the watermark are late and dropped. Rows without an event time count as of 1970.
    ``stream_upsert`` has no such limit. Keys are kept in ``buckets`` by their hash, a number that a checkpoint fixes. A task looks at the
    rows of a bucket a batch at a time and holds one row for each new key in it.
    """
    spark = changes.sparkSession
    epoch = F.timestamp_millis(F.lit(0))
    span = spark.range(1).select(F.unix_millis(epoch + F.expr(f"interval {delay}"))).first()[0]
    by, columns = list(order or [event_time]), changes.columns
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    marked = changes.withWatermark(event_time, delay)
    keyed = marked.where(name != "").withColumns(
        {
            "_name": name,
            "_bucket": F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int"),
            "_ms": F.coalesce(F.unix_millis(event_time), F.lit(0).cast("long")),
        }
    )

    def first(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = pickle.loads(state.get[0]) if state.exists else {}
        now, best = state.getCurrentWatermarkMs(), None
        if not state.hasTimedOut:
            for rows in batches:
                rows = rows[~rows["_name"].isin(known.keys())]
                if not len(rows):
                    continue
                rows = rows if best is None else pd.concat([best, rows], ignore_index=True)
                best = rows.sort_values(by, kind="stable", na_position="first").drop_duplicates("_name")
        # forgotten after the batch whose watermark has passed them
        known = {n: until for n, until in known.items() if until >= now}
        if best is not None:
            known.update(zip(best["_name"], best["_ms"].clip(lower=now) + span + 1, strict=True))
        if known:
            state.update((pickle.dumps(known),))
            state.setTimeoutTimestamp(max(int(max(known.values())), now + 1))
        elif state.exists:
            state.remove()
        if best is not None:
            yield best[columns]

    kept = keyed.groupBy("_bucket").applyInPandasWithState(first, changes.schema, "seen binary", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.union(marked.where(name == "").select(columns))
