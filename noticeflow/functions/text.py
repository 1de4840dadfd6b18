"""Whitespace, markup and Markdown text expressions. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace set of ECMAScript regular expressions. Java's own \\s is ASCII only.
WS_CHARS = "".join(
    chr(point)
    for point in (
        *range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
    )
)

# The five named entities that documents may carry.
NAMED_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&amp;": "&",
}

# Characters escaped before text is shown in a page.
HTML_ESCAPES = {
    "&": "&amp;",
    "<": "&lt;",
    ">": "&gt;",
    '"': "&quot;",
    "'": "&#39;",
}

# Bullet characters that mark list entries in notices.
BULLET = "◦"
BULLETS = "[◦•]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once per row, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def non_empty(*columns: Column | str) -> Column:
    """First value that is neither null nor the empty string, else ''."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in columns], F.lit(""))


def squash_ws(column: Column | str) -> Column:
    """Remove all whitespace."""
    return F.translate(_col(column), WS_CHARS, "")


def normalise_ws(column: Column | str) -> Column:
    """Turn whitespace runs into one space and trim; null becomes ''."""
    # Mapping characters is several times cheaper than a regular expression over a wide class.
    spaces = F.translate(F.coalesce(_col(column), F.lit("")), WS_CHARS, " " * len(WS_CHARS))
    return F.trim(F.regexp_replace(spaces, " {2,}", " "))


def strip_ws(column: Column | str) -> Column:
    """Trim both ends with the wide whitespace set; null becomes ''."""
    return F.trim(F.coalesce(_col(column), F.lit("")), F.lit(WS_CHARS))


def fold(column: Column | str) -> Column:
    """Form in which filters compare text: no whitespace, lower case."""
    return F.lower(squash_ws(column))


def strip_tags(column: Column | str) -> Column:
    return F.regexp_replace(_col(column), "<[^>]+>", " ")


def _decode_numeric(column: Column, pattern: str, digits_from: int, base: int) -> Column:
    """Replace each distinct numeric entity of a text with its character.

    Code points beyond Unicode are left as written.
    """

    def replace_one(text: Column, entity: Column) -> Column:
        digits = F.substring(entity, F.lit(digits_from), F.length(entity) - F.lit(digits_from))
        code = F.conv(digits, base, 10).cast("decimal(20,0)")
        char = F.decode(F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0")), "UTF-32")
        return F.when(code <= 0x10FFFF, F.replace(text, entity, char)).otherwise(text)

    def replace_all(text: Column) -> Column:
        entities = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.aggregate(entities, text, replace_one)

    # Most texts hold no numeric entity: the fold is skipped for them.
    return let(column, lambda text: F.when(text.contains("&#"), replace_all(text)).otherwise(text))


def decode_entities(column: Column | str) -> Column:
    """Hexadecimal, then decimal, then named entities."""
    text = _decode_numeric(_col(column), "(?i)&#x[0-9a-f]+;", 4, 16)
    text = _decode_numeric(text, "&#[0-9]+;", 3, 10)
    for entity, char in NAMED_ENTITIES.items():  # & last, so that nothing is decoded twice
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def bullet_spacing(column: Column | str) -> Column:
    """Exactly one space on both sides of a bullet."""
    return F.regexp_replace(_col(column), f" *({BULLETS}) *", " $1 ")


def count_bullets(column: Column | str) -> Column:
    return F.regexp_count(_col(column), F.lit(BULLET))


def markup_text(column: Column | str) -> Column:
    """Readable text of a piece of markup."""
    text = decode_entities(strip_tags(column))
    return strip_ws(bullet_spacing(F.regexp_replace(text, "[\\t\\r\\n ]+", " ")))


def html_escape(column: Column | str) -> Column:
    text = F.coalesce(_col(column), F.lit(""))
    for char, escaped in HTML_ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(escaped))
    return text


def markdown_cell(column: Column) -> Column:
    text = F.replace(F.replace(column, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    return F.when(text == "", F.lit(" ")).otherwise(text)


def markdown_row(cells: Column) -> Column:
    """One table line from an array of cell texts."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_cell), " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """Table text from an array of arrays; the first row is the header."""
    first = F.element_at(rows, 1)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(first, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), markdown_row)
    table = F.array_join(F.concat(F.array(markdown_row(first), rule), body), "\n")
    return F.when(F.size(rows) == 0, F.lit("")).when(F.size(first) == 0, F.lit("")).otherwise(table)


def join_text(values: Column, separator: str = ", ", default: str | None = "-") -> Column:
    """Join the non-empty values of an array in order; ``default`` stands for none."""
    joined = F.array_join(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), separator)
    if default is None:
        return F.coalesce(joined, F.lit(""))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))
