"""The training-data operators against plain versions, on a small table and on odd inputs."""

import math
import random
from pathlib import Path
from urllib.parse import urlparse

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import (
    chunks, components, decontaminate, golay, language_model, lengths, licenses, mixing, neighbours, quality, queries, resemblance,
    simhash, substrings, tables, tokens,
)
from noticeflow.llm.license_templates import NOTICES

SF_DIR = "/root/testdata/sf0.001"
ODD_SCHEMA = "doc_id long, text string, _id int, _t1 string, chunk int, bucket string, hash int, item string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(50))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


def odd(spark, *texts, first=1):
    """Rows with extra columns whose names the operators use themselves; null ids for texts given as (None, text)."""
    out = []
    for i, t in enumerate(texts, start=first):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        out.append((doc_id, text, 1, "x", None, "y", 2, None))
    return spark.createDataFrame(out, ODD_SCHEMA)


def test_licenses_on_the_table(docs, rows):
    out = licenses.scan_licenses(docs).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        base = [s for s in r.spans if s.base]
        starts = [s.start for s in base]
        got = (r.n_words, len(base), min(starts, default=None), max(starts, default=None))
        assert (*got, ",".join(sorted({s.label for s in base}))) == brute.licenses(texts[r.doc_id])


def test_licenses_odd(spark):
    edited = NOTICES["mit"].replace("copy, modify, merge", "copy, modify and even merge").replace("free of charge", "gratis")
    df = odd(spark, None, "", "a " + NOTICES["mit"], edited + " x " + NOTICES["bsd"], (None, "CC BY-NC; cc by nc"), LONG)
    out = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert out[1].n_words == out[2].n_words == 0 and out[1].spans == []
    assert [(s.label, s.start, s.score) for s in out[3].spans] == [("mit", 1, 1.0)]
    assert [s.label for s in out[4].spans] == ["mit", "bsd"] and 0.6 < out[4].spans[0].score < 1
    assert [(s.label, s.start) for s in out[None].spans] == [("cc-by-nc", 0), ("cc-by-nc", 3)]
    assert out[6].spans == [] and out[6].n_words == 30_000
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert licenses.scan_licenses(df.union(df)).count() == 6


def test_licenses_with_words_put_in_at_every_place(spark):
    rows = []
    for label, notice in NOTICES.items():
        w = notice.split()
        rows += [(f"{label} {i}", " ".join([*w[:i], "inserted", *w[i:]])) for i in range(len(w) + 1)]
        if len(w) > 40:
            rows += [
                (f"{label} {i} {j}", " ".join([*w[:i], "inserted", *w[i:j], "again", *w[j:]]))
                for i in range(0, len(w), 3) for j in range(i + 8, len(w), 3)
            ]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    out = licenses.scan_licenses(df).collect()
    assert len(out) == len(rows)
    lost = [r.doc_id for r in out if r.doc_id.split()[0] not in {s.label for s in r.spans if not s.base}]
    assert lost == []


def test_lengths_on_the_table(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    sizes = [len(tokenizer.encode(t, add_special_tokens=False).ids) for _, t in rows]
    sums = lengths.suffix_sums(lengths.histogram(docs, queries.tokenizer_file())).cache()
    out = {r.length: r for r in sums.collect()}
    assert set(out) == set(sizes)
    for n, r in out.items():
        longer = [x for x in sizes if x > n]
        assert (r.docs, r.tokens, r.docs_longer, r.tokens_longer) == (sizes.count(n), n * sizes.count(n), len(longer), sum(longer))
        assert r.truncated_tokens == sum(min(x, n) for x in sizes) and r.share == pytest.approx(1 - len(longer) / len(sizes))
    limits = [0, 1, 77, 512, 2048, 10**6]
    got = {r.context: r for r in lengths.at_limits(sums, limits).collect()}
    for limit in limits:
        want = (sum(sizes), sum(min(x, limit) for x in sizes), sum(x > limit for x in sizes))
        assert (got[limit].total_tokens, got[limit].truncated_tokens, got[limit].truncated_docs) == want
    assert lengths.quantile(sums, 0.5) == sorted(sizes)[(len(sizes) - 1) // 2]


def test_lengths_odd(spark):
    df = odd(spark, None, "", "a b", (None, "a b"), LONG)
    counts = lengths.histogram(df, queries.tokenizer_file(), extra=1)
    assert {r.length: r.docs for r in counts.collect() if r.length < 100} == {1: 2, 3: 2} and counts.count() == 3
    empty = lengths.suffix_sums(lengths.histogram(df.limit(0), queries.tokenizer_file()))
    assert empty.count() == 0 and lengths.quantile(empty, 0.5) is None


def test_tokens_on_the_table(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    want = brute.tokens(rows, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    tokens.write_tokens(docs, str(tmp_path / "t"), queries.tokenizer_file())
    out = tokens.read_tokens(spark, str(tmp_path / "t")).withColumn("crc", F.crc32("ids")).collect()
    assert {r.id: (r.start, r.n_tokens, r.crc) for r in out} == want
    one = rows[7][0]
    [r] = tokens.read_tokens(spark, str(tmp_path / "t"), lambda i: i == one).collect()
    assert (r.id, r.start) == (one, want[one][0])


def test_tokens_odd(spark, tmp_path):
    path = str(tmp_path / "t")
    df = odd(spark, (None, "a b c"), (2, None), (1, "x y"), (1, "x y"), (1, "a"), (3, ""), (4, LONG))
    tokens.write_tokens(df, path, queries.tokenizer_file(), end=0)
    out = tokens.read_tokens(spark, path).withColumn("a", tokens.as_array(F.col("ids"))).orderBy("start").collect()
    assert [r.id for r in out] == [None, 1, 1, 1, 2, 3, 4]
    assert sorted(map(tuple, (r.a for r in out[1:4]))) == [(64, 0), (87, 331, 0), (87, 331, 0)] and out[4].a == [0]
    tokens.write_tokens(df.limit(0), path + "0", queries.tokenizer_file())
    assert tokens.read_tokens(spark, path + "0").count() == 0


def test_tokens_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    key, held, staged = "spark.sql.execution.arrow.maxBytesPerBatch", [], tokens.tables.staged

    def noted(df, label):
        held.append(spark.conf.get(key))
        return staged(df, label)

    monkeypatch.setattr(tokens.tables, "staged", noted)
    before, path = spark.conf.get(key), str(tmp_path / "t")
    tokens.write_tokens(odd(spark, "a b", "c"), path, queries.tokenizer_file())
    assert held == [str(tokens.BATCH_BYTES)] and spark.conf.get(key) == before
    assert tokens.read_tokens(spark, path).count() == 2
    texts = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    with tokens._small_batches(spark):
        sizes = [r.size for r in texts.mapInArrow(size, "size long").collect()]
    assert max(sizes) < 2 * tokens.BATCH_BYTES and sum(sizes) > 40 << 20


def test_pieces_encode_as_the_whole_text():
    encoder = tokens.Encoder(queries.tokenizer_file())
    texts = ["", "  ", "a  b", "\n\n x y\t\tz ", "it's  he'll\n\nx 12  ??", "a\xa0\n\nb  c", "!\x1c x", "<|endoftext|> hi",
             "日本 語  テスト　x", " lead", "trail \n", "tab\t tab  \r\n end", "a  b"]
    rng = random.Random(5)
    texts += ["".join(rng.choice(" \n\t'ab1?é語\x0b") for _ in range(60)) for _ in range(200)]
    for text, got in zip(texts, encoder.encode(texts, 7), strict=True):
        assert got.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 7]


def test_special_tokens_in_texts_encode_as_the_library_does(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|>b  c", "\n<|endoftext|>\t<|endoftext|> x", "<|endoftext| >", "x y"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(want[0]) == 4
    for ids, got in zip(want, tokens.Encoder(queries.tokenizer_file()).encode(texts, 7), strict=True):
        assert got.tolist() == [*ids, 7]
    counts = lengths.histogram(odd(spark, *texts), queries.tokenizer_file()).collect()
    assert sum(r.length * r.docs for r in counts) == sum(map(len, want))


def test_known_pieces_serve_later_tasks_and_stay_bounded(monkeypatch):
    path = queries.tokenizer_file()
    own, learned = tokens.Encoder(path), []
    learn = own._learn
    monkeypatch.setattr(tokens, "encoder", lambda _: own)
    monkeypatch.setattr(own, "_learn", lambda new: learned.append(len(new)) or learn(new))

    def task(*texts):
        learned.clear()
        batch = pa.RecordBatch.from_pydict({"text": list(texts)})
        got = [ids.tolist() for _, found in tokens.encoded(iter([batch]), path, 7) for ids in found]
        assert got == [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]
        return sum(learned)

    assert task("one two one", "", "one  three\n") == 5
    assert task("one two four", " two one") == 1 and task("one two", " two one") == 0
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 12)
    # "one", " two" and " one" were met again, so they outlive the others
    assert task("one two " + " ".join(map(str, range(20)))) == 20 and len(own.known) <= 12
    assert task("one two", " one five") == 1 and task("a b", "one two five", "\xe9t\xe9 \u8a9e") > 0
    monkeypatch.setattr(tokens, "KNOWN_BYTES", 20)
    assert task("x" * 100, "one two") > 0 and own.known.nbytes <= 20 and task("one two", "x" * 100) > 0


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def test_language_model_on_the_table(docs, rows):
    out = language_model.score(docs, ~held_out()).collect()
    want = brute.unigram(rows)
    assert len(out) == len(want)
    for r in out:
        *exact, base = want[r.doc_id]
        assert [not r.learned, r.n_tokens, r.n_known, r.train_tokens] == exact
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in out if not r.learned]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_a_distribution(spark):
    """Probabilities of all words after a word sum to one, the unknown word included."""
    train = ["a b a c", "a b", "c a b b", "b"]
    known = ["a", "b", "c", "", "zzz"]
    asked = [f"a {w}".strip() if w else "a" for w in known]
    df = odd(spark, *train, *asked)
    out = {r.doc_id: r for r in language_model.score(df, F.col("doc_id") <= 4).collect()}
    by = {w: 10 ** out[5 + i].score for i, w in enumerate(known)}
    ends = {r: 10 ** out[r].score for r in out}
    first = ends[8] / 1.0  # "a" then the end
    assert first == pytest.approx(by[""])
    twice = language_model.score(odd(spark, *train, "", "a", "b", "c", "zzz"), F.col("doc_id") <= 4).collect()
    assert {r.doc_id: r.n_known for r in twice if r.doc_id > 4} == {5: 1, 6: 2, 7: 2, 8: 2, 9: 1}


def test_seating_follows_the_restaurant():
    """Mean tables of the sampler against a plain simulation, also where waiting times are drawn."""
    rng = np.random.default_rng(1)
    d, weight = 0.6, 0.4
    for customers in (1, 5, 300):
        got = language_model.seat(np.full(4000, customers), lambda at, t: weight + 0 * t, d, rng).mean()
        plain = []
        for _ in range(1500):
            tables = 1
            for seated in range(1, customers):
                tables += rng.random() < weight / (weight + seated - d * tables)
            plain.append(tables)
        assert got == pytest.approx(np.mean(plain), rel=0.06)


def test_language_model_odd(spark):
    df = odd(spark, None, "", (None, "x y"), "x y", "x y", LONG)
    out = language_model.score(df, F.col("doc_id") != 99).collect()
    assert len(out) == 6 and all(math.isfinite(r.score) and r.learned for r in out)
    assert language_model.score(df, F.lit(False)).where("n_known > 0").count() == 0
    assert language_model.score(df.limit(0), F.lit(True)).count() == 0


def test_numbers_pack():
    columns = [np.array([], dtype=np.int64), np.array([0, 255, 256, 1 << 62]), np.zeros(1000, dtype=np.int64)]
    packed = chunks.pack_numbers(*columns)
    assert [x.tolist() for x in chunks.unpack_numbers(packed)] == [x.tolist() for x in columns] and len(packed) < 100
    runs, sizes = np.array([3, 5, 9, 1, 7, 7, 8]), np.array([3, 1, 3])
    assert chunks.steps(runs, sizes).tolist() == [3, 2, 4, 1, 7, 0, 1]
    assert chunks.unsteps(chunks.steps(runs, sizes), sizes).tolist() == runs.tolist()


def test_language_model_writes_less_than_the_text(spark, monkeypatch):
    """Tables on the way: they were more than the text itself, as every pair took hashes and doubles."""
    drawn = np.random.default_rng(5).zipf(1.1, size=400_000) % 200_000
    texts = [" ".join(f"word{x}" for x in part) for part in np.split(drawn, 400)]
    written, staged = [], tables.staged

    def weighed(df, label):
        out = staged(df, label)
        written.extend(Path(urlparse(x).path).stat().st_size for x in out.inputFiles())
        return out

    monkeypatch.setattr(tables, "staged", weighed)
    out = language_model.score(odd(spark, *texts), F.lit(True)).agg(F.sum("n_tokens"), F.max("train_tokens")).first()
    assert list(out) == [400_400, 400_400]
    assert sum(written) < 0.5 * sum(map(len, texts)), sum(written) / sum(map(len, texts))


def test_quality_learns_grades(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    texts, grades = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        grade = i % 3
        if grade < 2:
            w.insert(rng.randrange(len(w)), rng.choice(["rubbish", "nonsense"]))
        if grade < 1:
            w += ["%%%", "&&&"] * (len(w) // 2)
        texts.append(" ".join(w))
        grades.append(grade)
    df = odd(spark, *texts)
    ratings = spark.createDataFrame([(i, g) for i, g in enumerate(grades, start=1) if i % 4], "doc_id long, grade int")
    ratings = ratings.union(spark.createDataFrame([(None, 1), (1, None), (999_999, 2), (2, 7)], "doc_id long, grade int"))
    model = quality.train(df, ratings, "doc_id", "text", "grade", grades=3)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = quality.grade(df, model, "text").where("doc_id % 4 = 0").collect()
    right = [round(r.quality.expected) == grades[r.doc_id - 1] for r in out]
    assert sum(right) / len(right) > 0.9
    assert all(r.quality.at_least[0] >= r.quality.at_least[1] for r in out)


def test_quality_odd(spark):
    df = odd(spark, None, "", (None, "x"), LONG, "x", "x")
    ratings = df.select("doc_id", F.lit(1).alias("grade")).limit(0)
    model = quality.train(df, ratings, "doc_id", "text", "grade", grades=3)
    out = quality.grade(df, model, "text", "hash")
    assert out.columns.count("hash") == 1 and out.count() == 6
    assert quality.grade(df.limit(0), model, "text").count() == 0


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    x[:3] = [0, 2**64 - 1, 1]
    row, key = golay.keys(x)
    mine = [set(key[row == i].tolist()) for i in range(len(x))]
    for bits in range(5):
        flips = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in x]
        row, key = golay.keys(x ^ np.array(flips, dtype=np.uint64))
        assert all(mine[i] & set(key[row == i].tolist()) for i in range(len(x)))


@pytest.mark.parametrize("group", [4096, 8])
def test_simhash_on_the_table(docs, rows, group):
    prints = {i: brute.fingerprint(t) for i, t in rows}
    want = brute.components(prints)
    out = simhash.near_copies(docs, group=group).collect()
    assert {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in out} == {i: (prints[i], want[i]) for i in prints}


def test_simhash_odd(spark):
    df = odd(spark, (5, None), (4, ""), (None, " \t"), (8, "One two THREE"), (7, "one two three"), (9, LONG), (7, "one two three"))
    out = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(df).collect()), key=str)
    assert out == sorted([(5, 4), (4, 4), (None, 4), (8, 7), (7, 7), (9, 9), (7, 7)], key=str)
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)] + [(8, 7), (8, 8), (None, 3)]
    random.Random(2).shuffle(chain)
    out = {r.node: r.root for r in components.connected(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert all(out[i] == 100 for i in range(100, 161)) and all(out[i] == 7 for i in (7, 8, *range(200, 260)))


def vectors(spark, values):
    return spark.createDataFrame(values, "vec_id long, embedding array<float>, node int, score int")


def test_neighbours_find_what_a_full_search_finds(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    index = neighbours.build(table, "vec_id", "embedding", keep=6, degree=16, group=128)
    out = neighbours.search(index, table.where("vec_id % 50 = 0"), "vec_id", "embedding", k=5).collect()
    data = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table.select("vec_id", "embedding").collect()}
    found = total = 0
    for query in {r.query_id for r in out}:
        cosine = {
            i: v @ data[query] / (np.linalg.norm(v) * np.linalg.norm(data[query])) for i, v in data.items() if i != query
        }
        best = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        own = sorted((r for r in out if r.query_id == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(cosine[r.id]) for r in own)
        found += len({r.id for r in own} & set(best))
        total += 5
    assert found / total >= 0.9


def test_neighbours_odd(spark):
    same = [(i, [1.0, 2.0, 0.0], 0, 0) for i in range(10, 40)]
    bad = [(1, None, 0, 0), (2, [0.0, 0.0, 0.0], 0, 0), (3, [1.0, None, 0.0], 0, 0), (4, [float("nan"), 1.0, 0.0], 0, 0),
           (5, [float("inf"), 1.0, 0.0], 0, 0), (6, [1.0], 0, 0), (None, [1.0, 1.0, 1.0], 0, 0)]
    df = vectors(spark, [*same, *bad, (50, [2.0, 4.0, 0.0], 0, 0), (51, [0.0, 0.0, 3.0], 0, 0)])
    index = neighbours.build(df, "vec_id", "embedding", keep=6)
    out = neighbours.search(index, df, "vec_id", "embedding", k=5)
    got = {r.query_id: r.ids for r in out.groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()}
    assert got[10] == [11, 12, 13, 14, 15] and got[39] == [10, 11, 12, 13, 14] and got[50] == [10, 11, 12, 13, 14]
    assert set(got) == {*range(10, 40), 50, 51} and len(got[51]) == 5
    empty = neighbours.build(df.limit(0), "vec_id", "embedding", keep=6)
    assert neighbours.search(empty, df.limit(0), "vec_id", "embedding", k=5).count() == 0


def test_substrings_on_the_table(docs, rows):
    out = {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in
           substrings.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()}
    assert out == dict(zip((i for i, _ in rows), brute.repeats(rows), strict=True))


def test_substrings_odd(spark):
    once = " ".join(f"u{i}" for i in range(40))
    texts = [None, "", "  ", f"a b {PASSAGE} c", f"{PASSAGE}\nd", (None, once), "same " * 80, LONG, f"x {once}"]
    df = odd(spark, *texts)
    out = substrings.remove_repeats(df, bucket_bytes=1 << 12).collect()
    plain = [t[1] if isinstance(t, tuple) else t for t in texts]
    want = brute.repeats(list(enumerate(plain)))
    assert sorted((r.n_words, r.n_removed) for r in out) == sorted(w[:2] for w in want)
    by = {r.doc_id: r for r in out}
    assert [tuple(x) for x in by[4].removed] == [(2, 52)] and by[4].kept == "a b c" and by[5].kept == "d"
    assert substrings.remove_repeats(df.limit(0)).count() == 0
    assert substrings.remove_repeats(df.union(df)).count() == 18


@pytest.mark.parametrize("entropy, passes", [(0.9, 4.0), (0.95, 1.5), (None, 2.0), (0.99, None)])
def test_mixture_exponent(spark, entropy, passes):
    sizes = {"a": 8000, "b": 900, "c": 800, "d": 300, None: 100, "none": 0}
    counts = spark.createDataFrame([(k, v, 10) for k, v in sizes.items()], "source string, tokens long, docs long")
    plan = mixing.mixture(counts, entropy, passes)
    share = {k: v / 10_100 for k, v in sizes.items() if v}

    def measure(a):
        w = {k: s**a for k, s in share.items()}
        total = sum(w.values())
        w = {k: x / total for k, x in w.items()}
        per = [w[k] / sizes[k] for k in w]
        return -sum(x * math.log(x) for x in w.values()) / math.log(5), max(per) / min(per)

    level, most = measure(plan.exponent)
    assert (entropy is None or level <= entropy + 1e-6) and (passes is None or most <= passes + 1e-6)
    if plan.exponent > 0:  # a little flatter breaks a limit
        level, most = measure(plan.exponent - 1e-4)
        assert (entropy is not None and level > entropy) or (passes is not None and most > passes)
    assert plan.weights.agg(F.sum("weight")).first()[0] == pytest.approx(1)


def test_mix_takes_whole_passes_and_even_blocks(spark):
    rng = random.Random(4)
    values = [(i, "big" if i % 10 else ("s", None)[i % 20 == 0], rng.randrange(0, 40)) for i in range(4000)]
    df = spark.createDataFrame(values, "doc_id long, source string, tokens long").withColumn("block", F.lit("mine"))
    out = mixing.mix(df, "source", "tokens", entropy=0.9, block_tokens=4000, bucket_docs=100)
    got = out.select("document.doc_id", "document.tokens", "source", "pass", "block").collect()
    assert {r.doc_id for r in got} == set(range(4000))
    plan = {r.source: r for r in mixing.mixture(
        df.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), 0.9, 4.0).weights.collect()}
    for source, w in plan.items():
        own = [r for r in got if r.source == source]
        assert w.quota <= sum(r.tokens for r in own) < w.quota + 40 + 1e-6
        assert len({(r.doc_id, r["pass"]) for r in own}) == len(own)
    blocks = 1 + max(r.block for r in got)
    for source, w in plan.items():
        sizes = [sum(r.tokens for r in got if r.source == source and r.block == b) for b in range(blocks)]
        assert max(sizes) - min(sizes) <= 80


def test_mix_odd(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, "a", 3), (2, "a", 3), (None, "a", 0), (3, "empty", 0)], "doc_id int, source string, tokens int"
    )
    out = mixing.mix(df, "source", "tokens").select("document.doc_id").collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted([1, 2, 2, None, 3], key=str)
    assert mixing.mix(df.limit(0), "source", "tokens").count() == 0


def test_passages_on_the_table(spark, docs, rows):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    want = brute.passages(rows, [tuple(r) for r in items.select("item_id", "text").collect()])
    out = decontaminate.find_passages(docs, items).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in out} == want
    assert all(sum(h.end - h.start for h in r.hits) == r.n_hit for r in out)


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_passages_odd(spark, broadcast_rows):
    items = [(1, PASSAGE), (2, None), (3, ""), (4, "tiny Item"), (None, "one"), (5, "same " * 30), (1, PASSAGE),
             (6, " ".join(f"shared{i}" for i in range(10, 30)))]
    texts = [None, "", "a tiny item; TINY-ITEM one", f"x {PASSAGE} y", "same " * 50, LONG,
             (None, " ".join(PASSAGE.split()[5:18])), " ".join(PASSAGE.split()[5:17])]
    df = odd(spark, *texts)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id int, text string, doc_id int")
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, start=1)]
    want = brute.passages(pairs, [("null" if i is None else i, t) for i, t in items])
    out = decontaminate.find_passages(df, bench, broadcast_rows=broadcast_rows).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in out} == want
    if broadcast_rows:
        assert decontaminate.find_passages(df, bench.limit(0)).where("n_hit > 0").count() == 0
        assert decontaminate.find_passages(df.limit(0), bench).count() == 0
        assert decontaminate.find_passages(df.union(df), bench).count() == 8


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()] if "text" in docs.columns else []
        out = stage(spark, docs, SF_DIR)
        after = out.cache()
        ids = {r[0] for r in after.select("doc_id").collect()}
        if i < 4:
            assert out.columns == names
        if i == 1:
            want = brute.linked({d: brute.shingles(t) for d, t in before}, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
            assert ids == set(want.values())
        if i == 2:
            bench = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
            want = brute.passages(before, bench)
            assert ids == {d for d, (n, hit, _) in want.items() if not (hit and 20 * hit >= n)}
        if i in (3, 4):
            assert ids == {d for d, _ in before}
        if i == 4:
            assert after.count() == len(before)
        docs = after


def test_pipeline_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    clashing = ["_text", "_grade", "_tokens", "_score", "_t1", "row", "tokens", "grade", "document", "root", "hash", "quality"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40)
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in clashing])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in clashing)
    graded = quality.grade(docs, queries.quality_model(spark, SF_DIR), "text")
    assert graded.columns == [c for c in docs.columns if c != "quality"] + ["quality"] and graded.first()["_score"].startswith("_score ")


def test_pipeline_drops_copies_with_edits(spark):
    import corpus_pipeline

    rng = random.Random(8)
    originals = [[f"word{rng.randrange(3000)}" for _ in range(200)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    for i, w in enumerate(originals):
        for copy in range(1, 4):
            edited = list(w)
            # three edits change at most 15 of 196 shingles; eight change 40 of them, so those are not near
            for at in (20, 90, 160) if copy < 3 else range(10, 190, 23):
                edited[at] = f"edit{copy}x{at}"
            rows.append((100 * copy + i, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF_DIR).collect()}
    assert out == set(range(20)) | set(range(300, 320))


def test_pipeline_keeps_unlike_texts_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    def text(i):
        return " ".join(f"t{i}w{k}" for k in range(30))

    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (None, text(4)), (8, text(3)),
            (None, text(5)), (None, text(5)), (9, text(6)), (9, text(6)), (None, None), (10, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, SF_DIR).collect()), key=str)
    want = [(None, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (None, text(5)), (9, text(6)), (10, None)]
    assert out == sorted(want, key=str)


def test_pipeline_drops_copies_by_simhash(spark, monkeypatch):
    import corpus_pipeline

    found = []

    def near_copies(*args, **options):
        found.append(near(*args, **options))
        return found[-1]

    near = simhash.near_copies
    monkeypatch.setattr(simhash, "near_copies", near_copies)
    line = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, line), (2, line + " w399"), (3, "other words"), (4, None)], "doc_id long, text string")
    out = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF_DIR).collect()}
    assert out == {1, 3, 4} and len(found) == 1
    roots = sorted(r.n for r in found[0].groupBy("component_id").agg(F.count("*").alias("n")).collect())
    assert roots == [1, 1, 2]


def test_texts_that_resemble_each_other_too_little_are_no_candidates():
    import pyarrow as pa

    rng = random.Random(5)
    base = [f"word{i}" for i in range(300)]
    texts = []
    for _ in range(80):
        edited = list(base)
        # five shingles for each edit: similarities of 0.6 to 0.75
        for at in rng.sample(range(5, 295), 5):
            edited[at] = f"edit{rng.random()}"
        texts.append(" ".join(edited))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(80)), pa.array(range(80)), pa.array(range(80)), pa.array(texts, pa.string())], ["id", "_t1", "_t2", "_text"]
    )
    signed = pa.Table.from_batches(resemblance._sign(5, "id")(iter([batch])))
    table = signed.append_column("own", pa.array([0] * 80)).append_column("root", signed.column("node"))
    sets = {int(n): brute.shingles(t) for n, t in zip(signed.column("node").to_pylist(), texts, strict=True)}
    linked = sum(5 * len(a & b) >= 4 * len(a | b) for a in sets.values() for b in sets.values() if a is not b) // 2
    pairs = resemblance._pairs(80, True)(table)
    assert linked < 100
    got = {(a, b) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)}
    assert {(min(x, y), max(x, y)) for x, a in sets.items() for y, b in sets.items() if x != y and 5 * len(a & b) >= 4 * len(a | b)} <= got
    assert len(got) <= linked + 80


@pytest.mark.parametrize("group", [1024, 8])
def test_resembling_texts_on_the_table(docs, rows, group):
    sets = {i: brute.shingles(t) for i, t in rows}
    want = brute.linked(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    by = {}
    for r in resemblance.groups(docs, "doc_id", "text", group=group).collect():
        by.setdefault(r.root, set()).add(r.doc_id)
    assert {i: min(ids) for ids in by.values() for i in ids} == want


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_run(spark, name):
    query, sql = queries.QUERIES[name]
    if sql:
        import check

        assert check.compare(spark, SF_DIR, name, query, sql).startswith("ok")
    elif name.startswith(("op5", "op7", "op9")):
        assert query(spark, SF_DIR).count() > 0
