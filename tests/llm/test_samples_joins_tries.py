"""Importance resampling, the n-gram Jaccard join and the conversation trie against plain versions."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import importance, jaccard, prefix_trie, queries

SF_DIR = "/root/testdata/sf0.001"
ODD_SCHEMA = "doc_id long, text string, _text string, row int, weight int, n_words string, number int"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


def odd(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, None, 3) for r in rows], ODD_SCHEMA)


def test_crc_of_runs_at_any_length():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"abcdefgh\xc3\xa9019", k=n)) for n in (1, 2, 15, 16, 17, 63, 64, 65, 127, 128, 1000, 70_001, 3)]
    data = np.frombuffer(b" ".join(words) + bytes(16), dtype=np.uint8)
    sizes = np.array(list(map(len, words)))
    starts = np.cumsum(sizes + 1) - sizes - 1
    empty = importance.Head(
        4, *importance._table(4, np.empty(0, dtype=np.int64), *(np.empty(0, dtype=k) for k in (np.uint64, np.uint64, np.uint32))), 4,
        np.full(16, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(16, dtype=np.uint32),
    )
    runs = list(importance.features(empty, data, starts, sizes, np.zeros(len(words), dtype=np.int64)))
    for n, (_, crc) in enumerate(runs, start=1):
        assert crc.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("most", [1 << 16, 64, 1])
def test_buckets_are_exact_with_any_head(spark, docs, rows, most):
    head = importance.learn_head(docs, "text", head_words=most, head_pairs=most)
    shared = spark.sparkContext.broadcast(head)
    want = np.bincount([b for _, t in rows for b in brute.buckets(t)[1]], minlength=10_000)
    assert (importance.bucket_totals(docs, shared) == want).all()


def test_resampling_on_the_table(spark, rows):
    bench = [r[0] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("text").collect()]
    out = queries.op11_importance_resampling(spark, SF_DIR)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute.resampled(rows, bench)


def test_resampling_odd(spark):
    rng = random.Random(5)
    texts = [None, "", "  ", "É Ünï A-b c", "ONE", " ".join("word%d" % rng.randrange(40) for _ in range(60_000)), "x" * 300 + " yes " + "y" * 70]
    texts += [" ".join(rng.choices(["red", "Green", "blue", "a", "of"], k=rng.randrange(10, 40))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, texts[-1])]
    target = spark.createDataFrame([("red green",), (None,), ("of of a",)], "text string")
    noise = F.floor(-1000 * F.ln(-F.ln((F.conv(F.substring(F.sha2(F.concat(F.lit("42:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0)))

    def run(df, target, percent=30):
        out = importance.draw(importance.weigh(df, target), noise, F.col("doc_id"), F.col("n_words") >= 20, percent)
        return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)

    assert run(odd(spark, rows), target) == brute.resampled(rows, ["red green", None, "of of a"], percent=30)
    assert run(odd(spark, rows), target.limit(0)) == brute.resampled(rows, [], percent=30)
    assert run(odd(spark, rows).limit(0), target) == []
    able = sum(brute.buckets(t)[0] >= 20 for _, t in rows)
    twice = run(odd(spark, rows).union(odd(spark, rows)), target)
    assert len(twice) == 2 * len(rows) and sorted(r[4] for r in twice if r[4]) == list(range(1, 30 * 2 * able // 100 + 1))


def similar(a, b, percent=90):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def test_jaccard_join_on_the_table(spark, rows):
    out = queries.op12_jaccard_join(spark, SF_DIR)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    sets = {i: brute.shingles(t, 3) for i, t in rows}
    want = brute.linked(sets, similar)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == {i: (len(x), want[i]) for i, x in sets.items()}


@pytest.mark.parametrize("group,depth,percent", [(4096, 32, 90), (8, 3, 90), (16, 5, 60)])
def test_jaccard_join_of_edited_copies(spark, group, depth, percent):
    rng = random.Random(11)
    rows = []
    for family in range(4):
        # a chain of edits, so that near ends of it are linked and far ones are not
        w = [f"f{family}w{rng.randrange(60)}" for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(25):
            rows.append((len(rows), " ".join(w)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
    rows += [(1000 + i, " ".join(rng.choices("abcdef", k=rng.randrange(0, 9)))) for i in range(60)]
    rng.shuffle(rows)
    sets = {i: brute.shingles(t, 3) for i, t in rows}
    want = brute.linked(sets, lambda a, b: similar(a, b, percent))
    assert 4 < len(set(want.values())) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.join(df, percent=percent, group=group, depth=depth).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(x), want[i]) for i, x in sets.items()}


def test_trie_rules_out_no_link():
    rng = np.random.default_rng(4)
    for depth in (2, 6, 20):
        base = np.sort(rng.choice(1000, 30, replace=False)).astype(np.uint64)
        sets = [np.sort(np.unique(np.concatenate([[0], rng.choice(base, 26, replace=False), rng.choice(1000, 2)]))).astype(np.uint64) for _ in range(60)]
        paths = np.array([np.concatenate([x[1:], np.full(depth, jaccard.END)])[:depth] for x in sets])
        order = np.lexsort(paths.T[::-1])
        sets, paths = [sets[i] for i in order], paths[order]
        n = np.array(list(map(len, sets)))
        zero = np.zeros(60, dtype=np.int64)
        trie = jaccard.Trie(paths, zero, -20 * n, n - 1, np.arange(60), zero - 1)
        got = [(min(x, y), max(x, y)) for a, b in trie.self_join(80) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got))
        want = {
            (i, j) for i in range(60) for j in range(i + 1, 60)
            if similar(set(sets[i].tolist()), set(sets[j].tolist()), 80)
        }
        assert want <= set(got)
        if depth == 20:
            assert len(got) < 60 * 59 // 2


def test_jaccard_join_odd(spark):
    text = " ".join(f"w{i}" for i in range(100))
    long = " ".join(f"v{i % 9973}x{i % 7}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One TWO"), (5, "one two"), (6, text), (7, text.upper() + " end"), (7, "other words of the same id"),
            (None, text), (None, "nobody else has this"), (8, long), (9, long + " and a tail"), (9, long + " and a tail")]
    out = jaccard.join(odd(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    size = len(brute.shingles(long, 3))
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 98, 6), (7, 99, 6), (7, 4, 7), (None, 98, 6), (None, 2, None),
            (8, size, 8), (9, size + 3, 8), (9, size + 3, 8)]
    assert got == sorted(want, key=str)
    assert jaccard.join(odd(spark, rows).limit(0)).count() == 0


def sequences(spark, rows, shape="conv_id long, turn long, role string, text string"):
    return prefix_trie.sequences(prefix_trie.numbered(spark.createDataFrame(rows, shape), "conv_id", "turn", "role", "text"))


def test_trie_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_conversation_trie(spark, SF_DIR)
    assert out.columns == TRIE
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute.trie(brute.rebuilt(rows))


@pytest.mark.parametrize("shard_turns", [1 << 17, 40, 3])
def test_trie_over_ranges(spark, shard_turns):
    rng = random.Random(9)
    made = {}
    for c in range(-60, 240):
        depth = rng.choice([1, 2, 2, 3, 4, 9])
        made[c] = [("u" if d % 2 else "a", rng.choice(["", "hé", "longer text"]) if c % 3 else "same") for d in range(depth)]
    made[500] = [("u", f"t{i % 3}") for i in range(150)]
    made[501] = made[500][:130]
    made[502] = made[500][:70] + [("u", "other")]
    rows = [(c, i, *t) for c, ts in made.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    out = prefix_trie.nodes(sequences(spark, rows), shard_turns).select(*TRIE)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute.trie(made)


def test_trie_odd(spark):
    rows = [(1, None, "u", "z"), (1, 0, None, None), (1, 0, "a", "b"), (100, 5, "u", "x"), (100, 5, "u", "x"), (None, 1, "u", "lost"), (101, 0, "u", "x"),
            (102, 0, "u", "x"), (-7, 1, "u", "x"), (-107, 1, "u", "x" * 100_000), (0, 3, "u", "z")]
    extra = [(*r, 1, "p", None) for r in rows]
    shape = "conv_id int, turn int, role string, text string, depth int, t1 string, pos int"
    turns = prefix_trie.numbered(spark.createDataFrame(extra, shape), "conv_id", "turn", "role", "text")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    out = prefix_trie.with_heads(prefix_trie.sequences(turns), F.col("conv_id") - F.col("conv_id") % 100, head, 5)
    found = prefix_trie.nodes(out).select(*TRIE).collect()
    assert sorted(map(tuple, found), key=str) == brute.trie(brute.rebuilt(rows))
    assert prefix_trie.nodes(out.limit(0)).count() == 0
    turnless = prefix_trie.nodes(out.limit(0).union(spark.createDataFrame([(5, []), (6, [])], out.schema))).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in turnless] == [(5, 0, 2, 1)]
