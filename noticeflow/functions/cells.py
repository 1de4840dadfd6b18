"""Cells of stored and exported CSV files, and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType

from .text import _col


def as_text(column: Column | str, data_type: DataType) -> Column:
    """Text form of a value: JSON for nested values, '' for null."""
    value = _col(column)
    if isinstance(data_type, (ArrayType, MapType, StructType, VariantType)):
        value = F.to_json(value)
    elif not isinstance(data_type, StringType):
        value = value.cast("string")
    return F.coalesce(value, F.lit(""))


def text_cell(column: Column | str) -> Column:
    """Wrap a text as ="text", so that spreadsheets keep leading zeros; empty stays empty."""
    value = F.coalesce(_col(column), F.lit(""))
    return F.when(value == "", value).otherwise(F.concat(F.lit('="'), value, F.lit('"')))


def untext_cell(column: Column | str) -> Column:
    """Undo :func:`text_cell`; also reads the older form =text."""
    value = F.coalesce(_col(column), F.lit(""))
    wrapped = (F.length(value) >= 3) & value.startswith('="') & value.endswith('"')
    return (
        F.when(~value.startswith("="), value)
        .when(wrapped, F.substring(value, F.lit(3), F.length(value) - 3))
        .otherwise(F.substring(value, F.lit(2), F.length(value)))
    )


def csv_escape(column: Column | str) -> Column:
    """Quote only where a comma, quote or newline makes it necessary."""
    value = F.coalesce(_col(column), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\\n]'), quoted).otherwise(value)


def json_or_default(column: Column | str, schema: DataType | str, default: Column) -> Column:
    """Parse JSON text; ``default`` where it is missing or malformed."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(_col(column)), "$", _ddl(schema)), default)


def _ddl(schema: DataType | str) -> str:
    return schema if isinstance(schema, str) else schema.simpleString()
