"""The corpus pipeline: quality, near copies, benchmark passages, mixture, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last one return the columns of ``docs``.
:func:`run` writes what a stage returns to the shared folder and gives the next one the table read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import decontaminate, mixing, quality, resemblance, tables, tokens, words
from noticeflow.llm.queries import quality_model, tokenizer_file
from noticeflow.session import work_dir

#: Hashes and models have no counterpart in SQL; the tests hold the rows against a version without Spark.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that are likelier of a lower grade than of the best one. The model is trained on the labels."""
    model = quality_model(spark, sf_dir)
    graded = quality.grade(docs.select(_row(docs), "text"), model, "text", "grade")
    return graded.where(F.col("grade.at_least")[1] >= 0.5).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that share four fifths of their five-word shingles, the one of least id.

    Near copies are found by SimHash (:func:`simhash.near_copies`, as in ``op6``) and checked on whole sets; pairs beyond its
    four bits are looked for by MinHash.
    A document is an id with a text: rows of one id, or of none, with other texts are documents of their own. Null ids
    come last, equal ones go by the keys of their texts. Of rows that repeat id and text, one is kept.
    """
    groups = resemblance.groups(docs, "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t1", "_t2"))
    keep = groups.groupBy("root").agg(first.alias("first")).select("first.*").drop("none")
    keyed = docs.select(_row(docs), "doc_id", *words.text_keys("text"))
    same = [keyed[c].eqNullSafe(keep[c]) for c in ("doc_id", "_t1", "_t2")]
    return keyed.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_t1", "_t2"]).select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents of which a twentieth or more is benchmark text."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_passages(docs, bench, "doc_id", "text")
    bad = found.where(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id").distinct()
    return docs.join(tables.small(bad, 500_000), docs.doc_id.eqNullSafe(bad.doc_id), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flatten the shares of the sources. Small ones are taken more than once; every document is taken at least once."""
    counted = docs.select(_row(docs), "source", mixing.word_count("text").alias("tokens"))
    mixed = mixing.mix(counted, "source", "tokens", entropy=0.9, most_passes=4.0)
    return mixed.select("document.row.*")


def write_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and what is read back from them: ``doc_id, start, n_tokens, ids_crc32``."""
    path = work_dir(spark, "corpus") + "/tokens"
    tokens.write_tokens(docs, path, tokenizer_file(), "doc_id", "text", end=0)
    out = tokens.read_tokens(spark, path)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _row(docs: DataFrame) -> Column:
    """All columns in one, so that no working column of a stage can meet one of the table."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicate removal", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("source mixture", mix_sources),
    ("token output", write_out),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = tables.staged(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
