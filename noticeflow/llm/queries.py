"""The operators of this subpackage over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.session import work_dir
from noticeflow.llm import (
    decontaminate, importance, jaccard, language_model, lengths, licenses, mixing, neighbours, prefix_trie, quality, simhash, substrings,
    tokens,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"].cast("long"))

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(table(spark, sf_dir, "documents"), tokenizer_file()))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens") + "/files"
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file(), end=0)
    out = tokens.read_tokens(spark, path)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    out = language_model.score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Grades 0 to 2: a point for each of good quality and no toxic words."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return quality.train(table(spark, sf_dir, "documents"), labels, "doc_id", "text", "grade", grades=3)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.grade(documents, quality_model(spark, sf_dir), "text")
    return out.select(
        "doc_id",
        F.col("quality.expected").alias("expected_grade"),
        F.col("quality.at_least")[0].alias("p_grade_1"),
        F.col("quality.at_least")[1].alias("p_grade_2"),
        (F.col("quality.at_least")[1] >= 0.5).alias("keep"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_copies(table(spark, sf_dir, "documents"), shingle=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = neighbours.build(vectors, "vec_id", "embedding", keep=6)
    found = neighbours.search(index, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("n_words"))
    out = mixing.mix(documents, "source", "n_words", entropy=0.9, most_passes=4.0)
    return out.select("document.doc_id", "source", "document.n_words", "pass", "block", "position")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = importance.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000)
    digest = F.sha2(F.concat(F.lit("42:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    out = importance.draw(weighed, noise, F.col("doc_id"), F.col("n_words") >= 20, percent=5)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.join(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    rebuilt = prefix_trie.with_heads(prefix_trie.sequences(turns, "conv_id"), F.col("conv_id") - F.col("conv_id") % 100, head, most=5)
    return prefix_trie.nodes(rebuilt)


# Windows of all items as a table, and equality joins on them.
OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM item_words WHERE len(w) > 0))),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM doc_windows JOIN windows USING (n, words)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

# Sets as rows, pairs by an equality join of their shingles, components by walking the links.
OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM r JOIN e ON x = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_license_scan": (op1_license_scan, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_token_output": (op3_token_output, None),
    "op4_language_model": (op4_language_model, None),
    "op5_quality_classifier": (op5_quality_classifier, None),
    "op6_simhash": (op6_simhash, None),
    "op7_nearest_neighbours": (op7_nearest_neighbours, None),
    "op8_substring_dedup": (op8_substring_dedup, None),
    "op9_temperature_mixing": (op9_temperature_mixing, None),
    "op10_decontamination": (op10_decontamination, OP10_SQL),
    "op11_importance_resampling": (op11_importance_resampling, None),
    "op12_jaccard_join": (op12_jaccard_join, OP12_SQL),
    "op13_conversation_trie": (op13_conversation_trie, None),
}
