"""Benchmark passages in documents, found by winnowed fingerprints. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import let
from noticeflow.llm import tables, words


def find_passages(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    gram: int = 7,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """Words of documents inside any occurrence of ``window`` consecutive words of an item.

    An item of fewer words, but not none, is one window. Winnowing keeps the smallest hash of ``window - gram + 1``
    neighbouring ``gram``-word hashes on both sides, so every shared window shares a fingerprint. A shared fingerprint
    gives a place in a document and one in an item, around which all windows are then compared word by word.

    Returns a row per (id, text): ``id_col, n_words, n_hit``, the array ``items`` of ids of items that occur (as
    strings, sorted) and ``hits``, the (start, end) word intervals of their occurrences, merged. Null and empty texts
    have no words, rows that repeat id and text give one row, null ids are kept as an id of their own, items with a null
    id count as ``null``. An empty item table gives no hits. Further columns are ignored.

    Fingerprints of items and the keys of documents with candidates are broadcast up to ``broadcast_rows`` rows, which
    are counted first; beyond that both joins shuffle.
    """
    bench = tables.staged(
        items.select(
            F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("item"),
            words.word_array(item_text_col).alias("item_words"),
        )
        .where(F.size("item_words") > 0)
        .distinct()
        .withColumn("item_key", F.xxhash64("item_words")),
        "benchmark",
    )
    lengths = [r[0] for r in bench.select(F.least(F.size("item_words"), F.lit(window)).alias("n")).distinct().collect()]
    short = sorted(n for n in lengths if n < window)  # fewer than ``window`` values, whatever the size of the benchmark
    mark = let(F.col("item_words"), lambda w: F.array_distinct(_fingerprints(w, window, gram, short)))
    known = tables.staged(bench.select(F.explode(mark).alias("hash")).distinct(), "fingerprints")

    docs = documents.select(F.col(id_col).alias("_id"), *words.text_keys(text_col), F.col(text_col).alias("_text"))
    # Each document leads its fingerprints with a row of its own, so that one scan gives both.
    found = docs.select(
        "_id", "_t1", "_t2",
        F.posexplode(let(words.word_array("_text"), lambda w: F.concat(
            F.array(F.size(w).cast("long")), F.array_distinct(_fingerprints(w, window, gram, short))
        ))).alias("_at", "_value"),
    )
    known = tables.small(known, broadcast_rows)
    joined = found.join(known, (found._value == known.hash) & (found._at > 0), "left").where("_at = 0 OR hash IS NOT NULL")
    candidates = tables.staged(
        joined.groupBy("_id", "_t1", "_t2").agg(
            F.max(F.when(F.col("_at") == 0, F.col("_value"))).alias("n_words"), F.collect_set("hash").alias("hashes")
        ),
        "candidates",
    )
    hits = _hits(docs, candidates, bench, window, gram, short, broadcast_rows)
    same = [candidates[c].eqNullSafe(hits["h" + c]) for c in ("_id", "_t1", "_t2")]
    return candidates.join(hits, same, "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits"),
    )


def contaminated(n_hit: Column, n_words: Column, least_share: float = 0.05) -> Column:
    """At least ``least_share`` of the words are hit."""
    return (n_hit > 0) & (n_hit >= F.lit(least_share) * n_words)


def _fingerprints(w: Column, window: int, gram: int, short: list[int]) -> Column:
    """Smallest gram hash of every window of the words, and the hashes of all runs of the lengths in ``short``."""
    none = F.array().cast("array<bigint>")
    least = let(words.gram_hashes(w, gram), lambda g: words.over_runs(g, window - gram + 1, lambda a, b: F.least(a, b)))
    parts = [F.when(F.size(w) >= window, least).otherwise(none)]
    for n in short:
        # on the benchmark's side this gives more than its short items need, which costs some candidates only
        parts.append(F.when(F.size(w) >= n, words.gram_hashes(w, n)).otherwise(none))
    return F.concat(*parts) if short else parts[0]


def _placed(n: int) -> Callable[[Column, Column], Column]:
    return lambda g, i: F.struct(g.alias("hash"), i.alias("at"), F.lit(n).alias("size"))


def _places(w: Column, sizes: list[int], wanted: Column | None) -> Column:
    """(hash, position, length) of the runs of the given lengths, as far as their hashes are wanted."""
    kind = "array<struct<hash:bigint,at:int,size:int>>"
    parts = []
    for n in sizes:
        at = F.transform(words.gram_hashes(w, n), _placed(n))
        if wanted is not None:
            at = F.filter(at, lambda x: F.array_contains(wanted, x["hash"]))
        parts.append(F.when(F.size(w) >= n, at.cast(kind)).otherwise(F.array().cast(kind)))
    return F.concat(*parts)


def _hits(docs, candidates, bench, window: int, gram: int, short: list[int], broadcast_rows: int) -> DataFrame:
    """Windows that really occur, per document with candidates."""
    sizes = sorted({gram, *short})
    slack = window - gram
    asked = candidates.where(F.size("hashes") > 0).select(
        F.col("_id").alias("h_id"), F.col("_t1").alias("h_t1"), F.col("_t2").alias("h_t2"), "hashes"
    )
    keys = [docs[c].eqNullSafe(asked["h" + c]) for c in ("_id", "_t1", "_t2")]
    texts = docs.join(tables.small(asked, broadcast_rows), keys).select(
        "h_id", "h_t1", "h_t2", words.word_array("_text").alias("w"), "hashes"
    )
    # A window with this fingerprint reaches no further than ``slack`` words before or behind it.
    places = F.transform(_places(F.col("w"), sizes, F.col("hashes")), lambda x: F.struct(
        x["hash"].alias("hash"), x["at"].alias("at"), x["size"].alias("size"),
        F.greatest(x["at"] - slack, F.lit(0)).alias("from"),
        F.slice("w", F.greatest(x["at"] - slack, F.lit(0)) + 1, F.lit(window + slack)).alias("near"),
    ))
    found = texts.select("h_id", "h_t1", "h_t2", F.explode(places).alias("d")).select("h_id", "h_t1", "h_t2", "d.*")
    marks = bench.select(
        "item", "item_key", F.explode(_places(F.col("item_words"), sizes, None)).alias("m"), F.size("item_words").alias("of")
    ).select("item", "item_key", F.col("m.hash").alias("hash"), F.col("m.size").alias("size"), F.col("m.at").alias("item_at"), "of")
    # runs as long as a short item stand for that item alone
    marks = marks.where(F.when(F.col("of") < window, F.col("size") == F.col("of")).otherwise(F.col("size") == gram)).drop("of")
    pairs = found.join(tables.small(marks, broadcast_rows), ["hash", "size"]).join(
        tables.small(bench, broadcast_rows), ["item", "item_key"]
    )
    n = F.least(F.size("item_words"), F.lit(window))
    shift = F.col("at") - F.col("item_at")
    first = F.greatest(F.col("at") + F.col("size") - n, F.lit(0), shift)
    last = F.least(F.col("at"), F.size("item_words") + shift - n, F.col("from") + F.size("near") - n)
    starts = F.when(last >= first, F.filter(
        F.sequence(first, last),
        lambda j: F.slice("near", j - F.col("from") + 1, n) == F.slice("item_words", j - shift + 1, n),
    ))
    runs = pairs.select("h_id", "h_t1", "h_t2", "item", n.alias("n"), F.explode(starts).alias("j")).select(
        "h_id", "h_t1", "h_t2", "item", F.struct(F.col("j").alias("start"), (F.col("j") + F.col("n")).alias("end")).alias("run")
    )
    per = runs.groupBy("h_id", "h_t1", "h_t2").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set("run")).alias("runs")
    )
    merged = F.aggregate("runs", F.array().cast("array<struct<start:int,end:int>>"), _merge)
    covered = F.aggregate("hits", F.lit(0), lambda n_, x: n_ + x["end"] - x["start"])
    return per.withColumn("hits", merged).select("h_id", "h_t1", "h_t2", "items", "hits", covered.alias("n_hit"))


def _merge(done: Column, run: Column) -> Column:
    """Add a run, in order of starts, to merged intervals."""
    last = F.try_element_at(done, F.lit(-1))
    apart = (F.size(done) == 0) | (run["start"] > last["end"])
    head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
    return F.when(apart, F.concat(done, F.array(run))).otherwise(F.concat(head, F.array(grown)))
