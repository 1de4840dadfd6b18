"""A hierarchical Pitman-Yor language model of words in the context of the word before, trained and applied in Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from noticeflow.llm import chunks, tables, words

#: The end of a text, as a word hash; it is also the context of the first word.
END = np.uint64(0xA0761D6478BD642F)
#: Text whose pairs one task holds.
BUCKET_BYTES = 3 << 20
LOWERED = np.frombuffer(words.LOWER_TABLE, dtype=np.uint8)


@dataclass(frozen=True)
class Settings:
    """``discount`` and ``strength`` of the restaurants of one-word contexts and of their parent; sweeps of the sampler."""

    discount: float = 0.85
    strength: float = 1.0
    parent_discount: float = 0.6
    parent_strength: float = 1.0
    burn_in: int = 1
    samples: int = 3
    seed: int = 42


def score(
    documents: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Train on the rows for which ``learn`` holds (null: it does) and score all of them.

    Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end for each text. Each word is a context
    with a restaurant of its own, whose dishes are the words that follow; all of them share one parent, the restaurant
    of words without context, over a uniform base of the known words and one place for unknown ones.

    The seating is sampled by Gibbs. A sweep draws for each dish of a restaurant the tables of its customers anew, one
    customer after the other, given the tables of the other dishes and the parent's probabilities. It starts from every
    customer at a table of its own, so that the parent first knows the plain counts; then the tables of the contexts
    become the customers of the parent, whose tables are sampled in the same way. Predictive probabilities are averaged
    over the sweeps after ``burn_in``.

    Returns a row per input row: ``id_col, learned, n_tokens, n_known`` (tokens that occur in training), the totals
    ``train_tokens`` and ``train_types``, ``base_score`` (add-half unigram) and ``score``, both log10 probabilities of the
    text. Null texts are empty (the end alone), null ids stay, repeated rows are rows of their own; without any row to
    learn from all tokens are unknown. Further columns are ignored.

    Counts cover all words and pairs. Chunks of documents send their distinct words and pairs to tasks that hold a range
    of the hash space (64 bits), and get counts and probabilities back; a frequent word or pair costs an entry per chunk.
    From the first counts on a word is known by its bucket and its place among the hashes there, so that what is sent for
    a pair is a small difference; answers are whole numbers (customers, and tables summed over the sweeps).
    A restaurant is one entry per distinct pair and stays in one task; its size is bounded by the vocabulary.
    """
    spark = documents.sparkSession
    buckets = chunks.bucket_count(documents, text_col, bucket_bytes)
    keyed = documents.select(
        F.struct(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(True)).alias("learn")).alias("key"), F.col(text_col).alias("text")
    )
    rows = chunks.packed_chunks(keyed, "key", "text")

    asked = chunks.map_chunks(keyed, "key", "text", _ask_words(buckets), "chunk long, bucket int, hashes binary, counts binary")
    counts = asked.groupBy("bucket").applyInArrow(
        _count_words, "chunk long, bucket int, places binary, a binary, total long, types long, width int"
    )
    counts = tables.staged(counts, "counts")
    per = counts.groupBy("bucket").agg(*(F.max(c).alias(c) for c in ("total", "types", "width")))
    whole = (F.sum("total"), F.sum("types"), F.max("width"))
    total, types, width = per.agg(*(F.coalesce(c, F.lit(0)) for c in whole)).first()

    pairs = _with_answers(rows, counts.select("chunk", F.lit(0).alias("kind"), "bucket", "a", "places")).mapInArrow(
        _ask_pairs(buckets, width), "chunk long, bucket int, pairs binary"
    )
    seated = pairs.groupBy("bucket").applyInArrow(
        _seat(settings, total, types, buckets, width), "chunk long, bucket int, a binary"
    )
    seated = tables.staged(seated, "seats")

    questions = counts.select("chunk", "bucket", F.col("places").alias("a")).union(seated.where("chunk IS NULL"))
    parent = questions.groupBy("bucket").applyInArrow(
        _seat_parent(settings, types), "chunk long, bucket int, a binary, customers long, tables long"
    )
    parent = tables.staged(parent, "parents")
    per = parent.groupBy("bucket").agg(F.max("customers").alias("k"), F.max("tables").alias("t"))
    customers, all_tables = per.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()

    none = F.lit(None).cast("binary").alias("places")
    answers = (
        counts.select("chunk", F.lit(0).alias("kind"), "bucket", "a", none)
        .union(parent.where("chunk IS NOT NULL").select("chunk", F.lit(1), "bucket", "a", none))
        .union(seated.where("chunk IS NOT NULL").select("chunk", F.lit(2), "bucket", "a", none))
    )
    known = (total, types, customers, all_tables)
    id_type = keyed.schema["key"].dataType["id"].dataType
    schema = StructType(
        [
            StructField(id_col, id_type),
            StructField("learned", BooleanType()),
            *(StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens", "train_types")),
            StructField("base_score", DoubleType()),
            StructField("score", DoubleType()),
        ]
    )
    return _with_answers(rows, answers).mapInArrow(_apply(settings, buckets, known, schema.names), schema)


def _with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    # rows of equal content share their answers, which then come more than once
    listed = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "a", "places")).alias("answers"))
    return rows.join(listed, "chunk", "left")


def _tokens(batch: pa.RecordBatch, i: int):
    """(token hashes, document of each, distinct hashes in order, index of each token in them)"""
    data, offsets = chunks.chunk_texts(batch, i)
    data = LOWERED[data]
    starts, ends = words.spans(data)
    doc = np.searchsorted(offsets[1:], starts, side="right")
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n) + 1
    tokens = np.full(int(counts.sum()), END, dtype=np.uint64)
    tokens[np.arange(len(starts)) + doc] = words.word_hashes(data, starts, ends)
    docs = np.repeat(np.arange(n), counts)
    distinct, index = np.unique(tokens, return_inverse=True)
    return tokens, docs, distinct, index


def _learned(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column("ids")[i].values.field("learn").to_numpy(zero_copy_only=False).astype(bool)


def _pairs(distinct: np.ndarray, index: np.ndarray):
    """Distinct pairs (index of the context, index of the word), by context, and the pair of each token."""
    end = int(np.searchsorted(distinct, END))
    before = np.concatenate([[end], index[:-1]])
    pairs, which = np.unique(before * len(distinct) + index, return_inverse=True)
    return pairs // len(distinct), pairs % len(distinct), which


def _ask_words(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = chunks.bucket_bounds(buckets)
        for batch, i in chunks.chunk_rows(batches):
            _, docs, distinct, index = _tokens(batch, i)
            counts = np.bincount(index, weights=_learned(batch, i)[docs], minlength=len(distinct)).astype(np.int64)
            cuts = chunks.bucket_cuts(distinct, bounds)
            used = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("chunk")[i].as_py()] * len(used), pa.int64()),
                    pa.array(used, pa.int32()),
                    pa.array([chunks.pack_sorted(distinct[cuts[b] : cuts[b + 1]]) for b in used], pa.binary()),
                    pa.array([chunks.pack_numbers(counts[cuts[b] : cuts[b + 1]]) for b in used], pa.binary()),
                ],
                ["chunk", "bucket", "hashes", "counts"],
            )

    return ask


def _count_words(group: pa.Table) -> pa.Table:
    hashes = [chunks.unpack_sorted(x.as_py()) for x in group.column("hashes")]
    counts = np.concatenate([chunks.unpack_numbers(x.as_py())[0] for x in group.column("counts")])
    sizes = np.array([len(x) for x in hashes])
    distinct, index = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(sums, index, counts)
    tops = np.cumsum(sizes)[:-1]
    n = group.num_rows
    return pa.table(
        {
            "chunk": group.column("chunk"),
            "bucket": group.column("bucket"),
            "places": pa.array([chunks.pack_numbers(x) for x in np.split(chunks.steps(index, sizes), tops)], pa.binary()),
            "a": pa.array([chunks.pack_numbers(x) for x in np.split(sums[index], tops)], pa.binary()),
            "total": pa.array([int(sums.sum())] * n, pa.int64()),
            "types": pa.array([int(np.count_nonzero(sums))] * n, pa.int64()),
            # bits that hold the place of any word of the bucket
            "width": pa.array([len(distinct).bit_length()] * n, pa.int32()),
        }
    )


def _answer(batch: pa.RecordBatch, i: int, kind: int, field: str = "a") -> dict[int, list[np.ndarray]]:
    found = batch.column("answers")[i].as_py() or []
    return {x["bucket"]: chunks.unpack_numbers(x[field]) for x in found if x["kind"] == kind}


def _joined(answers: dict[int, list[np.ndarray]], cuts: np.ndarray, columns: int = 1) -> list[np.ndarray]:
    """Answers of all buckets in the order of the hashes. A bucket without its answer is a KeyError: the input changed."""
    used = [answers[int(b)] for b in np.flatnonzero(np.diff(cuts))]
    return [np.concatenate([x[c] for x in used]) if used else np.empty(0, dtype=np.int64) for c in range(columns)]


def _ask_pairs(buckets: int, width: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = chunks.bucket_bounds(buckets)
        for batch, i in chunks.chunk_rows(batches):
            _, docs, distinct, index = _tokens(batch, i)
            cuts = chunks.bucket_cuts(distinct, bounds)
            (known,) = _joined(_answer(batch, i, 0), cuts)
            # counts of the words to a thousandth of their logarithm: the parent's first estimate
            base = np.round(np.log2(known + 1.0) * 1000).astype(np.int64)
            (places,) = _joined(_answer(batch, i, 0, "places"), cuts)
            sizes = np.diff(cuts)
            places = chunks.unsteps(places, sizes[sizes > 0])
            names = (np.repeat(np.arange(buckets), sizes) << width) + places
            context, word, which = _pairs(distinct, index)
            counts = np.bincount(which, weights=_learned(batch, i)[docs], minlength=len(context)).astype(np.int64)
            first = np.flatnonzero(np.diff(context, prepend=-1))
            sizes = np.diff(np.append(first, len(context)))
            followers = chunks.steps(names[word], sizes)
            contexts = places[context[first]]
            cuts = chunks.bucket_cuts(distinct[context[first]], bounds)
            tops = np.append(first, len(context))
            used = np.flatnonzero(np.diff(cuts))
            packed = []
            for b in used:
                own = slice(cuts[b], cuts[b + 1])
                pairs = slice(tops[cuts[b]], tops[cuts[b + 1]])
                packed.append(
                    chunks.pack_numbers(
                        np.diff(contexts[own], prepend=0), sizes[own], followers[pairs], counts[pairs], base[word[pairs]]
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("chunk")[i].as_py()] * len(used), pa.int64()),
                    pa.array(used, pa.int32()),
                    pa.array(packed, pa.binary()),
                ],
                ["chunk", "bucket", "pairs"],
            )

    return ask


def seat(customers: np.ndarray, weight, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of dishes after all their customers sat down, one after the other.

    ``weight(chosen, tables)`` is what a new table weighs for the dishes at the given places. The first customers are
    drawn one by one; later ones by the waiting time until the next new table, whose distribution is a power law.
    """
    taken = np.minimum(customers, 1)
    one_by_one = 12
    at = np.flatnonzero(customers > 1)
    for seated in range(1, one_by_one):
        if not len(at):
            break
        new = weight(at, taken[at])
        taken[at] += random.random(len(at)) * (new + seated - discount * taken[at]) < new
        at = at[customers[at] > seated + 1]
    at = np.flatnonzero(customers > one_by_one)
    seated = np.full(len(at), one_by_one, dtype=np.float64)
    while len(at):
        new = weight(at, taken[at])
        middle = np.maximum(seated - discount * taken[at] + (new - 1) / 2, 0.05)
        with np.errstate(over="ignore", divide="ignore"):
            wait = np.floor(middle * np.expm1(-np.log(random.random(len(at))) / new))
        seated = seated + wait + 1
        going = seated <= customers[at]
        at, seated = at[going], seated[going]
        taken[at] += 1
    return taken


def _seat(settings: Settings, total: int, types: int, buckets: int, width: int):
    def sample(group: pa.Table) -> pa.Table:
        asked = list(zip(*(chunks.unpack_numbers(x.as_py()) for x in group.column("pairs")), strict=True))
        contexts = [np.cumsum(x) for x in asked[0]]
        followers, sizes = np.concatenate(asked[2]), np.concatenate(asked[1])
        word = chunks.unsteps(followers, sizes)
        context = np.repeat(np.concatenate(contexts), sizes)
        counts, base = np.concatenate(asked[3]), np.concatenate(asked[4])
        order = np.lexsort((word, context))
        new_context = np.concatenate([[True], np.diff(context[order]) != 0])
        new_pair = new_context | np.concatenate([[True], np.diff(word[order]) != 0])
        pair = np.empty(len(order), dtype=np.int64)
        pair[order] = np.cumsum(new_pair) - 1
        firsts = order[new_pair]
        restaurant = (np.cumsum(new_context) - 1)[new_pair]
        n = np.bincount(pair, weights=counts, minlength=len(firsts)).astype(np.int64)
        m = int(restaurant[-1]) + 1
        # the parent before its own seating is known: counts of words, an unknown one as half an occurrence
        parent = np.maximum(2.0 ** (base[firsts] / 1000) - 1, 0.5) / (total + 0.5 * (types + 1))
        d, strength = settings.discount, settings.strength
        random = np.random.default_rng([settings.seed, int(group.column("bucket")[0].as_py())])
        # a single customer has a single table; only the others are drawn again
        several = np.flatnonzero(n > 1)
        where, many, chance = restaurant[several], n[several], parent[several]
        single = np.bincount(restaurant[n == 1], minlength=m)
        drawn = many.copy()
        # tables summed over the sweeps that count
        summed = np.where(n == 1, settings.samples, 0)
        summed_all = single * settings.samples
        for sweep in range(settings.burn_in + settings.samples):
            others = (single + np.bincount(where, weights=drawn, minlength=m))[where] - drawn
            drawn = seat(many, lambda at, t, o=others: (strength + d * (o[at] + t)) * chance[at], d, random)
            if sweep >= settings.burn_in:
                summed[several] += drawn
                summed_all += np.bincount(where, weights=drawn, minlength=m).astype(np.int64)
        seats = np.minimum(n, 1)
        seats[several] = drawn
        all_customers = np.bincount(restaurant, weights=n, minlength=m).astype(np.int64)
        # answers, in the order of the questions
        ends, tops = np.cumsum([len(x) for x in contexts]), np.cumsum([len(x) for x in asked[2]])
        asked_pairs = np.split(pair, tops[:-1])
        asked_contexts = np.split(restaurant[pair[np.cumsum(sizes) - sizes]], ends[:-1])
        replies = [
            chunks.pack_numbers(n[p], summed[p], all_customers[c], summed_all[c])
            for p, c in zip(asked_pairs, asked_contexts, strict=True)
        ]
        # customers of the parent: the tables of the last sweep
        w, at = np.unique(word[firsts], return_inverse=True)
        sent = np.bincount(at, weights=seats, minlength=len(w)).astype(np.int64)
        w, sent = w[sent > 0], sent[sent > 0]
        cuts = np.searchsorted(w, np.arange(buckets + 1) << width)
        used = np.flatnonzero(np.diff(cuts))
        places = w & ((1 << width) - 1)
        to_parent = [
            chunks.pack_numbers(np.diff(places[cuts[b] : cuts[b + 1]], prepend=0), sent[cuts[b] : cuts[b + 1]]) for b in used
        ]
        return pa.table(
            {
                "chunk": pa.array([*group.column("chunk").to_pylist(), *[None] * len(used)], pa.int64()),
                "bucket": pa.array([*group.column("bucket").to_pylist(), *used], pa.int32()),
                "a": pa.array([*replies, *to_parent], pa.binary()),
            }
        )

    return sample


def _seat_parent(settings: Settings, types: int):
    def sample(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk").to_pylist()
        asked = [chunks.unpack_numbers(x.as_py()) for x in group.column("a")]
        places = [np.cumsum(x[0]) for x in asked]
        # only the contexts send customers; the chunks ask, for every word of the bucket
        at = [p for p, c in zip(places, chunk, strict=True) if c is None]
        sent = [x[1] for x, c in zip(asked, chunk, strict=True) if c is None]
        known = max(int(p[-1]) for p in places) + 1
        n = np.zeros(known, dtype=np.int64)
        if at:
            np.add.at(n, np.concatenate(at), np.concatenate(sent))
        d, strength, base = settings.parent_discount, settings.parent_strength, 1 / (types + 1)
        random = np.random.default_rng([settings.seed, 1, int(group.column("bucket")[0].as_py())])
        own = int(np.count_nonzero(n))
        seats, summed = n.copy(), np.zeros(len(n), dtype=np.int64)
        for sweep in range(settings.burn_in + settings.samples):
            # the tables of all buckets, from those of this one
            everywhere = seats.sum() * types / max(own, 1)
            rest = everywhere - seats
            seats = seat(n, lambda at, t, o=rest: (strength + d * (o[at] + t)) * base, d, random)
            if sweep >= settings.burn_in:
                summed += seats
        rows = group.num_rows
        return pa.table(
            {
                "chunk": group.column("chunk"),
                "bucket": group.column("bucket"),
                "a": pa.array(
                    [None if c is None else chunks.pack_numbers(n[p], summed[p]) for c, p in zip(chunk, places, strict=True)],
                    pa.binary(),
                ),
                "customers": pa.array([int(n.sum())] * rows, pa.int64()),
                "tables": pa.array([int(summed.sum())] * rows, pa.int64()),
            }
        )

    return sample


def _apply(settings: Settings, buckets: int, known: tuple[int, int, int, int], names: list[str]):
    total, types, customers, all_tables = known
    samples = settings.samples

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = chunks.bucket_bounds(buckets)
        for batch, i in chunks.chunk_rows(batches):
            _, docs, distinct, index = _tokens(batch, i)
            cuts = chunks.bucket_cuts(distinct, bounds)
            (counts,) = _joined(_answer(batch, i, 0), cuts)
            seated, summed = _joined(_answer(batch, i, 1), cuts, 2)
            served = seated - settings.parent_discount * (summed / samples)
            new = (settings.parent_strength + settings.parent_discount * all_tables / samples) / (types + 1)
            parent = (served + new) / (settings.parent_strength + customers)
            context, word, which = _pairs(distinct, index)
            first = np.flatnonzero(np.diff(context, prepend=-1))
            sizes = np.diff(np.append(first, len(context)))
            cuts = chunks.bucket_cuts(distinct[context[first]], bounds)
            seated, summed, guests, taken = _joined(_answer(batch, i, 2), cuts, 4)
            pairs = seated - settings.discount * (summed / samples)
            guests, taken = np.repeat(guests, sizes), np.repeat(taken / samples, sizes)
            back = settings.strength + settings.discount * taken
            predicted = np.log10((pairs + back * parent[word]) / (settings.strength + guests))
            base = np.log10((counts + 0.5) / (total + 0.5 * (types + 1)))
            ids = batch.column("ids")[i].values
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.field("id"),
                    ids.field("learn"),
                    pa.array(np.bincount(docs, minlength=n), pa.int64()),
                    pa.array(np.bincount(docs, weights=counts[index] > 0, minlength=n).astype(np.int64), pa.int64()),
                    pa.array(np.full(n, total), pa.int64()),
                    pa.array(np.full(n, types), pa.int64()),
                    pa.array(np.bincount(docs, weights=base[index], minlength=n)),
                    pa.array(np.bincount(docs, weights=predicted[which], minlength=n)),
                ],
                names,
            )

    return apply
