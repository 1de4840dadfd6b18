"""Licence wording in documents, found by votes of word k-grams for diagonals of licence templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions.text import let
from noticeflow.llm import tables, words
from noticeflow.llm.license_templates import NOTICES, PHRASES

_SPAN = "struct<label:string,base:boolean,start:int,end:int,score:double>"


def scan_licenses(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    notices: Mapping[str, str] = NOTICES,
    gram: int = 3,
    slack: int = 12,
    least_score: float = 0.6,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """Places of licence phrases (all their words, consecutively) and of longer notices (edited ones too).

    The hash of every run of ``gram`` words of every document is joined to the positions of the same run in the
    templates. The hits of a document and a template vote for a diagonal, the difference of both positions. The votes are
    compared word by word; diagonals of a notice whose hits are at most ``slack`` words and ``slack`` diagonals apart merge
    into one span, so that words put in or left out don't break it. A span's score is the share of the notice's runs that
    it holds; spans of less than ``least_score`` are left out. A phrase counts if all its runs vote for one diagonal.

    Phrases must have at least ``gram`` words. Returns a row per (id, text): ``id_col, n_words`` and ``spans``, an array of
    (label, base, start, end, score) in the order of starts; ``base`` marks phrases. Null and empty texts have no words,
    rows that repeat id and text give one row, null ids are kept. Further columns are ignored.

    The template positions are joined by broadcast: there are as many as the templates have words. The keys of documents
    with hits are broadcast up to ``broadcast_rows`` rows, which are counted; beyond that the join shuffles.
    """
    templates = _templates(documents.sparkSession, phrases, notices, gram)
    marks = templates.select("template", F.posexplode(words.gram_hashes(F.col("words"), gram)).alias("t_at", "hash"))
    docs = documents.select(F.col(id_col).alias("_id"), *words.text_keys(text_col), F.col(text_col).alias("_text"))
    none = F.array().cast("array<bigint>")
    runs = let(words.word_array("_text"), lambda w: F.concat(
        F.array(F.size(w).cast("long")), F.when(F.size(w) >= gram, words.gram_hashes(w, gram)).otherwise(none)
    ))
    # the number of words comes first, so that one scan gives a row for each document, with hits or without
    found = docs.select("_id", "_t1", "_t2", F.posexplode(runs).alias("_at", "_value"))
    voted = (
        found.join(F.broadcast(marks), (found._value == marks.hash) & (found._at > 0), "left")
        .where("_at = 0 OR template IS NOT NULL")
        .groupBy("_id", "_t1", "_t2", "template", (F.col("_at") - 1 - F.col("t_at")).alias("diagonal"))
        .agg(F.max("_value").alias("n_words"), F.collect_set("t_at").alias("votes"))
    )
    diagonal = F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", F.array_sort("votes").alias("votes")))
    candidates = tables.staged(
        voted.groupBy("_id", "_t1", "_t2").agg(
            F.max(F.when(F.col("template").isNull(), F.col("n_words"))).alias("n_words"),
            F.collect_set(diagonal).alias("diagonals"),
        ),
        "license-candidates",
    )
    spans = _spans(docs, candidates, templates, gram, slack, least_score, broadcast_rows)
    same = [candidates[c].eqNullSafe(spans["s" + c]) for c in ("_id", "_t1", "_t2")]
    return candidates.join(spans, same, "left").select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans")
    )


def _templates(spark: SparkSession, phrases: Mapping[str, str], notices: Mapping[str, str], gram: int) -> DataFrame:
    rows = [(label, True, text) for text, label in phrases.items()]
    rows += [(label, False, text) for label, text in notices.items()]
    table = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], "template int, label string, base boolean, text string"
    )
    return table.select("template", "label", "base", words.word_array("text").alias("words")).where(F.size("words") >= gram)


def _spans(docs, candidates, templates, gram: int, slack: int, least_score: float, broadcast_rows: int) -> DataFrame:
    asked = candidates.where(F.size("diagonals") > 0).select(
        F.col("_id").alias("s_id"), F.col("_t1").alias("s_t1"), F.col("_t2").alias("s_t2"), "diagonals"
    )
    keys = [docs[c].eqNullSafe(asked["s" + c]) for c in ("_id", "_t1", "_t2")]
    texts = docs.join(tables.small(asked, broadcast_rows), keys).select(
        "s_id", "s_t1", "s_t2", "diagonals", words.word_array("_text").alias("w")
    )
    # of a document's words only those beside each voted run go on
    near = F.transform("diagonals", lambda d: F.struct(
        d["template"].alias("template"), d["diagonal"].alias("diagonal"), F.transform(d["votes"], lambda j: F.struct(
            j.alias("at"), F.slice("w", d["diagonal"] + j + 1, gram).alias("words"))).alias("votes"),
    ))
    lines = texts.select("s_id", "s_t1", "s_t2", F.explode(near).alias("d")).select("s_id", "s_t1", "s_t2", "d.*")
    lines = lines.join(F.broadcast(templates), "template")
    true = F.transform(
        F.filter("votes", lambda v: v["words"] == F.slice("words", v["at"] + 1, gram)), lambda v: v["at"]
    )
    lines = lines.select("s_id", "s_t1", "s_t2", "template", "label", "base", "diagonal", true.alias("votes"),
                         (F.size("words") - (gram - 1)).alias("runs")).where(F.size("votes") > 0)
    line = F.struct(
        (F.col("diagonal") + F.array_min("votes")).alias("start"),
        (F.col("diagonal") + F.array_max("votes") + gram).alias("end"), "diagonal", "votes",
    )
    per = lines.groupBy("s_id", "s_t1", "s_t2", "template", "label", "base", "runs").agg(
        F.array_sort(F.collect_set(line)).alias("lines")
    )
    merged = F.when(F.col("base"), F.transform("lines", lambda s: F.struct(s["start"], s["end"], s["votes"]))).otherwise(_merged("lines", slack))
    scored = F.transform(merged, lambda s: F.struct(
        F.col("label"), F.col("base"), s["start"].alias("start"), s["end"].alias("end"),
        (F.size(F.array_distinct(s["votes"])) / F.col("runs")).alias("score"),
    ).cast(_SPAN))
    kept = F.filter(scored, lambda s: F.when(s["base"], s["score"] == 1).otherwise(s["score"] >= least_score))
    return (
        per.select("s_id", "s_t1", "s_t2", F.explode(kept).alias("span"))
        .groupBy("s_id", "s_t1", "s_t2")
        .agg(F.array_sort(F.collect_set("span"), _by_start).alias("spans"))
    )


def _merged(lines: str, slack: int) -> Column:
    """Join lines with every open span beside them, in order of their first hits.

    A span keeps its least and greatest diagonal; as its lines lie at most ``slack`` diagonals apart, one within
    ``slack`` of these two is as near to one of them. A span is closed when a line starts further behind its end.
    """

    def add(state: Column, line: Column) -> Column:
        def beside(s: Column) -> Column:
            return line["diagonal"].between(s["low"] - slack, s["high"] + slack)

        def reached(s: Column) -> Column:
            return line["start"] <= s["end"] + slack

        joined = F.filter(state["open"], lambda s: reached(s) & beside(s))

        def each(field: str) -> Column:
            return F.transform(joined, lambda s: s[field])

        grown = F.struct(
            F.least(line["start"], F.array_min(each("start"))).alias("start"),
            F.greatest(line["end"], F.array_max(each("end"))).alias("end"),
            F.least(line["diagonal"], F.array_min(each("low"))).alias("low"),
            F.greatest(line["diagonal"], F.array_max(each("high"))).alias("high"),
            F.array_union(F.flatten(each("votes")), line["votes"]).alias("votes"),
        )
        return F.struct(
            F.concat(F.filter(state["open"], lambda s: reached(s) & ~beside(s)), F.array(grown)).alias("open"),
            F.concat(state["closed"], F.filter(state["open"], lambda s: ~reached(s))).alias("closed"),
        )

    none = F.array().cast("array<struct<start:int,end:int,low:int,high:int,votes:array<int>>>")
    start = F.struct(none.alias("open"), none.alias("closed"))
    return F.aggregate(lines, start, add, lambda state: F.transform(
        F.concat(state["closed"], state["open"]), lambda s: F.struct(s["start"], s["end"], s["votes"])
    ))


def _by_start(a: Column, b: Column) -> Column:
    def order(field: str, then: Column) -> Column:
        return F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(then)

    return order("start", order("end", order("label", F.lit(0))))
