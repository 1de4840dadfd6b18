"""Extraction requests and answers. The model that answers lies outside: requests are a table
that is written, answers a table that is read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType

from ..functions.ids import PART_SEPARATOR, PROMPT_ID, excerpt_window, extract_ids, head
from ..functions.nested import explode_rows
from ..functions.text import let, non_empty
from ..session import checkpointed
from ..spec import EXTRACTION, IDS_PER_REQUEST_HOSTED, OPTIONAL_EXTRACTION_FIELDS, RETRY_ROUNDS
from .dedup import last_write_wins
from .positions import running
from .sets import id_difference

#: Ids of a key that are gathered in one array before they are cut into requests.
MOST_IDS = 10_000

# Spellings under which answers give each field; the first is the schema's own.
OVERVIEW = ("사업개요", "businessOverview")
ID_RULE = ("ID부여규칙", "requirementIdRule")
DECLARED = ("요구사항수", "requirementCount")
REQUIREMENTS = ("요구사항목록", "requirementsList", "requirements")
DETAILS = ("ecr", "ecrDetails", "equipmentRequirements")
MISSING = ("누락", "missing")
OTHER = ("기타요구사항", "otherRequirements")
IDS = ("id", "ID", "requirementId", "reqNo")
CATEGORY = ("구분", "category")
ITEM_CATEGORY = ("분류", "category")
TITLE = ("명칭", "title", "name")
DEFINITION = ("정의", "definition")
DETAIL_TEXT = ("세부내용_원문", "detailOriginal", "details", "detail")
SPECS = ("기본규격", "basicSpecs", "specifications")
SPEC_FIELDS = {
    "구분": ("구분", "category"),
    "항목": ("항목", "item"),
    "요구사항": ("요구사항", "requirement", "specification"),
    "수량": ("수량", "quantity"),
}
DERIVED = ("파생규격", "derivedSpecs")
DERIVED_FIELDS = {n: (n,) for n in ("cpu", "ram", "gpu", "disk", "nic")} | {"기타": ("기타", "other")}
DELIVERABLES = ("산출물", "deliverables")
ORIGIN = ("출처", "source")
DOUBTS = ("불확실", "uncertainties")


# ---- answers to one schema


def _first(variant: Column, names: Sequence[str], type_: str) -> Column:
    return F.coalesce(*[F.try_variant_get(variant, f"$.{n}", type_) for n in names])


def _text(variant: Column, names: Sequence[str]) -> Column:
    return non_empty(*[F.try_variant_get(variant, f"$.{n}", "string") for n in names])


def _list(variant: Column, names: Sequence[str], type_: str = "variant") -> Column:
    return F.coalesce(_first(variant, names, f"array<{type_}>"), F.array().cast(f"array<{type_}>"))


def _requirement(item: Column) -> Column:
    return F.struct(
        _text(item, CATEGORY).alias("구분"),
        _text(item, ("ID", *[n for n in IDS if n != "ID"])).alias("ID"),
        _text(item, TITLE).alias("명칭"),
    )


def _item(item: Column) -> Column:
    derived = [
        non_empty(
            *[F.try_variant_get(item, f"$.{outer}.{inner}", "string") for outer in DERIVED for inner in names]
        ).alias(field)
        for field, names in DERIVED_FIELDS.items()
    ]
    specs = F.transform(
        _list(item, SPECS),
        lambda s: F.struct(*[_text(s, names).alias(field) for field, names in SPEC_FIELDS.items()]),
    )
    return F.struct(
        _text(item, IDS).alias("id"),
        _text(item, ITEM_CATEGORY).alias("분류"),
        _text(item, TITLE).alias("명칭"),
        _text(item, DEFINITION).alias("정의"),
        _text(item, DETAIL_TEXT).alias("세부내용_원문"),
        specs.alias("기본규격"),
        F.struct(*derived).alias("파생규격"),
        _list(item, DELIVERABLES, "string").alias("산출물"),
        _text(item, ORIGIN).alias("출처"),
        _list(item, DOUBTS, "string").alias("불확실"),
    )


def normalise_keys(raw: Column | str) -> Column:
    """Extraction struct from JSON text in any of the accepted spellings; null if malformed."""
    fields = EXTRACTION["사업개요"].dataType.names
    overview_type = "struct<" + ",".join(f"`{n}`:string" for n in fields) + ">"
    empty = F.struct(*[F.lit("").alias(n) for n in fields])

    def result(variant: Column) -> Column:
        return F.struct(
            F.coalesce(_first(variant, OVERVIEW, overview_type), empty).alias("사업개요"),
            _text(variant, ID_RULE).alias("ID부여규칙"),
            _first(variant, DECLARED, "int").alias("요구사항수"),
            F.transform(_list(variant, REQUIREMENTS), _requirement).alias("요구사항목록"),
            F.transform(_list(variant, DETAILS), _item).alias("ecr"),
            _list(variant, MISSING, "string").alias("누락"),
            F.transform(_list(variant, OTHER), _requirement).alias("기타요구사항"),
        )

    return let(F.try_parse_json(raw), lambda v: F.when(v.isNotNull(), result(v)))


def pick_number(raw: Column | str, names: Sequence[str], default: int = 0) -> Column:
    """A number from JSON text under the first spelling present."""
    found = let(F.try_parse_json(raw), lambda v: _first(v, names, "long"))
    return F.coalesce(found, F.lit(default).cast("long"))


def conforms(raw: Column | str, schema: DataType = EXTRACTION) -> Column:
    """Whether JSON text has exactly the schema's keys and types."""
    checked = let(F.try_parse_json(raw), lambda v: _conforms(v, schema))
    return F.coalesce(checked, F.lit(False))


def _conforms(variant: Column, schema: DataType) -> Column:
    kind = F.schema_of_variant(variant)
    if isinstance(schema, StructType):
        required = [n for n in schema.names if n not in OPTIONAL_EXTRACTION_FIELDS]
        checks = let(
            F.map_keys(F.try_variant_get(variant, "$", "map<string,variant>")),
            lambda keys: F.forall(keys, lambda k: k.isin(schema.names))
            & (F.size(F.array_intersect(keys, F.array(*map(F.lit, required)))) == len(required)),
        )
        for field in schema.fields:
            value = F.try_variant_get(variant, f"$.{field.name}", "variant")
            checks = checks & let(value, _field_check(field))
        return F.coalesce(checks, F.lit(False))
    if isinstance(schema, ArrayType):
        items = F.try_variant_get(variant, "$", "array<variant>")
        return F.coalesce(
            F.forall(items, lambda v: F.coalesce(_conforms(v, schema.elementType), F.lit(False))), F.lit(False)
        )
    if isinstance(schema, IntegerType):
        return kind.isin("BIGINT", "VOID")
    return kind == "STRING"


def _field_check(field: StructField):
    if field.name in OPTIONAL_EXTRACTION_FIELDS:
        return lambda value: value.isNull() | _conforms(value, field.dataType)
    return lambda value: _conforms(value, field.dataType)


# ---- requests


def chunk_array(ids: Column, size: int) -> Column:
    """Consecutive slices of at most ``size`` ids of one array."""
    starts = F.sequence(F.lit(0), F.size(ids) - 1, F.lit(size))
    return F.when(
        F.size(ids) > 0, F.transform(starts, lambda s: F.slice(ids, s + 1, F.lit(size)))
    ).otherwise(F.array().cast("array<array<string>>"))


def request_source(text: Column, ids: Column) -> Column:
    """Trimmed source of one request: the windows around its ids."""
    windows = let(
        F.reverse(text),
        lambda backwards: F.transform(ids, lambda i: excerpt_window(text, i, backwards)),
    )
    return F.array_join(windows, PART_SEPARATOR)


def plan_requests(
    documents: DataFrame,
    keys: Sequence[str],
    text: str,
    ids: str,
    size: int = IDS_PER_REQUEST_HOSTED,
    trim: bool = False,
) -> DataFrame:
    """Per document one summary request (number 0), then one per chunk of ids.

    Requests carry the whole text. With ``trim``, for models of short context, a summary gets its head and the others
    the windows around their ids (sizes in ``functions.ids``). Everything a request needs is in its document's row, so
    nothing is shuffled; a row gets its text after the chunks are rows, so no row holds a text twice.
    """
    chunks = F.concat(F.array(F.array().cast("array<string>")), chunk_array(F.col(ids), size))
    planned = explode_rows(documents, [*keys, F.col(text).alias("_text")], chunks, "ids", "request")
    summary = F.size("ids") == 0
    source = F.col("_text")
    if trim:
        source = F.when(summary, head(source)).otherwise(request_source(source, F.col("ids")))
    kind = F.when(summary, F.lit("summary")).otherwise(F.lit("details"))
    return planned.select(*keys, "request", kind.alias("kind"), "ids", source.alias("source"))


def prompt_ids(prompt: Column | str) -> Column:
    """Ids a request text names."""
    return extract_ids(prompt, PROMPT_ID)


def choose_ids(declared: Column, found: Column) -> Column:
    """Declared ids, unless more ids are found in the text. Both are arrays of one document."""
    return F.when(F.size(found) > F.size(declared), found).otherwise(declared)


def choose_expected(
    declared: DataFrame, found: DataFrame, keys: Sequence[str], identifier: str
) -> DataFrame:
    """The same choice over relations: the larger set of distinct ids of each key, with
    ``origin`` and its size ``expected``. Keys without ids do not appear."""

    def counted(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        ids = df.select(*keys, identifier).distinct()
        return ids, ids.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    declared_ids, declared_size = counted(declared, "_declared")
    found_ids, found_size = counted(found, "_found")
    sizes = declared_size.join(found_size, list(keys), "full").fillna(0, ["_declared", "_found"])
    more_found = F.col("_found") > F.col("_declared")
    chosen = sizes.select(
        *keys,
        F.when(more_found, F.lit("found")).otherwise(F.lit("declared")).alias("origin"),
        F.greatest("_found", "_declared").alias("expected"),
    )
    ids = declared_ids.withColumn("origin", F.lit("declared")).unionByName(
        found_ids.withColumn("origin", F.lit("found"))
    )
    return ids.join(chosen, [*keys, "origin"])


# ---- answers


def merge_responses(
    responses: DataFrame, expected: DataFrame, keys: Sequence[str], identifier: str, rounds: Sequence[str]
) -> DataFrame:
    """The last answer per expected id, with ``missing``; other ids are left out.

    ``rounds`` orders answers. ``expected`` may carry a position to sort the result by.
    """
    named = responses.where(F.coalesce(F.col(identifier), F.lit("")) != "")
    last = last_write_wins(named, [*keys, identifier], list(rounds))
    joined = expected.join(last.withColumn("_answered", F.lit(True)), [*keys, identifier], "left")
    return joined.withColumn("missing", F.col("_answered").isNull()).drop("_answered")


def order_as_expected(
    items: DataFrame, expected: DataFrame, keys: Sequence[str], ids: str, identifier: str
) -> DataFrame:
    """Items in the order of each key's ``ids`` array; items that are not listed drop out."""
    listed = explode_rows(expected, keys, F.col(ids), identifier, "position")
    return items.join(listed, [*keys, identifier]).orderBy(*keys, "position").drop("position")


def retry_missing(
    documents: DataFrame,
    expected: DataFrame,
    responses: DataFrame,
    keys: Sequence[str],
    identifier: str,
    attempt: int,
    size: int = IDS_PER_REQUEST_HOSTED,
    trim: bool = False,
) -> DataFrame | None:
    """Requests of the next round for ids without an answer; None after the last round.

    ``documents`` holds the keys and a ``text`` column. A request carries the whole text, or with ``trim`` the windows
    around its ids.
    """
    if attempt >= RETRY_ROUNDS:
        return None
    open_ids = id_difference(expected, responses, keys, identifier)
    return _requests(open_ids, documents, keys, identifier, size, trim)


def _of(ids: DataFrame, listed: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    return ids.alias("r").join(listed.alias("k"), same, how)


def _cut(ids: DataFrame, keys: Sequence[str], identifier: str, size: int) -> DataFrame:
    """Requests of keys whose ids fit into one array. A null id takes a place, as it does in :func:`running`."""
    listed = ids.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(identifier).alias("id")))).alias("_ids"))
    starts = F.sequence(F.lit(0), F.size("_ids") - 1, F.lit(size))
    cut = listed.select(*keys, "_ids", F.posexplode(starts).alias("request", "_start"))
    part = F.slice("_ids", F.col("_start") + 1, F.lit(size))["id"]
    return cut.select(*keys, F.col("request").cast("long").alias("request"), F.array_compact(part).alias("ids"))


def _requests(
    ids: DataFrame, documents: DataFrame, keys: Sequence[str], identifier: str, size: int, trim: bool, most: int = MOST_IDS
) -> DataFrame:
    """Requests of at most ``size`` ids. Keys with more than ``most`` ids are numbered over ranges, the others in one array."""
    named = ids.select(*keys, identifier)
    many = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    many = [] if (few := many.isEmpty()) else checkpointed(many.drop("_n"))
    grouped = _cut(named if few else _of(named, many, keys, "left_anti"), keys, identifier, size)
    if not few:
        numbered = running(_of(named, many, keys, "left_semi"), list(keys), [identifier], "_pos")
        chunked = numbered.withColumn("request", F.floor((F.col("_pos") - 1) / size))
        chunks = chunked.groupBy(*keys, "request").agg(F.array_sort(F.collect_list(identifier)).alias("ids"))
        grouped = grouped.unionByName(chunks)
    # the text joins the requests, so that no task holds a text as often as it is asked
    source = request_source(F.col("text"), F.col("ids")) if trim else F.col("text")
    return grouped.join(documents.select(*keys, "text"), list(keys)).select(*keys, "request", "ids", source.alias("source"))


def answer_rounds(
    documents: DataFrame,
    expected: DataFrame,
    ask: Callable[[DataFrame, int], DataFrame],
    keys: Sequence[str],
    identifier: str,
    size: int = IDS_PER_REQUEST_HOSTED,
    trim: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ask for all expected ids, then up to ``RETRY_ROUNDS`` times for those that are still missing.

    ``ask`` gets the requests of a round and its number (0 is the first one) and returns the answers: keys, id and what
    else they hold. Each round is stored before the next one is planned. Answers with ids that were not asked for are
    kept, as are later answers for an id beside earlier ones; :func:`merge_responses` takes the last by ``round``.

    Returns the answers with ``round``; a ledger with a row for every id and round in which it was asked for; and the ids
    that are missing in the end.
    """
    open_ids = checkpointed(expected.select(*keys, identifier).distinct())
    answers, ledger = None, None
    for attempt in range(RETRY_ROUNDS + 1):
        asked = open_ids.withColumn("round", F.lit(attempt))
        ledger = asked if ledger is None else ledger.unionByName(asked)
        requests = _requests(open_ids, documents, keys, identifier, size, trim)
        found = checkpointed(ask(requests, attempt).withColumn("round", F.lit(attempt)))
        answers = found if answers is None else answers.unionByName(found)
        named = found.where(F.coalesce(F.col(identifier), F.lit("")) != "")
        open_ids = checkpointed(id_difference(open_ids, named, keys, identifier))
        if open_ids.isEmpty():
            break
    return answers, ledger, open_ids


def build_items(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    part_size: int,
    **options,
) -> DataFrame:
    """Rows to ``items`` arrays per key, in order.

    An array holds at most ``part_size`` items; a longer list continues in the rows with
    ``part`` 1, 2, ... so that no key has to fit into one task.
    """
    numbered = running(df, list(keys), list(order), "_pos", **options)
    placed = numbered.withColumn("part", F.floor((F.col("_pos") - 1) / part_size))
    items = F.array_sort(F.collect_list(F.struct("_pos", F.struct(*fields).alias("item"))))
    return (
        placed.groupBy(*keys, "part")
        .agg(items.alias("_items"))
        .select(*keys, "part", F.col("_items.item").alias("items"))
    )


def explode_items(df: DataFrame, items: str = "items", keep_empty: bool = True) -> DataFrame:
    """One row per item with its position; results without items stay when ``keep_empty``."""
    rest = [c for c in df.columns if c != items]
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return df.select(*rest, explode(items).alias("item_ix", "_item")).select(*rest, "item_ix", "_item.*")


def usage_rollup(calls: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Calls and summed counters per result."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in counters]
    )
