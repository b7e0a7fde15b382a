"""The documented order of query results: typed string keys, compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Type


def bits(column: Column) -> Column:
    """The 64 bits of a double as 16 hex digits, from its exact hexadecimal form."""
    text = F.format_string("%a", column)  # [-]0x1.mantissa p exponent; 0x0. for zero and subnormal numbers
    low = F.rpad(F.regexp_extract(text, r"\.([0-9a-f]+)p", 1), 13, "0")
    power = F.regexp_extract(text, r"p(-?[0-9]+)$", 1).cast("long")
    field = F.when(text.startswith("0x0") | text.startswith("-0x0"), F.lit(0).cast("long")).otherwise(power + 1023)
    sign = F.when(text.startswith("-"), F.lit(2048)).otherwise(F.lit(0))
    usual = F.concat(F.lpad(F.lower(F.hex(field + sign)), 3, "0"), low)
    infinity = F.when(column > 0, F.lit("7ff0000000000000")).otherwise(F.lit("fff0000000000000"))
    return F.when(F.isnan(column), F.lit("7ff8000000000000")).when(F.abs(column) == F.lit(float("inf")), infinity).otherwise(usual)


def _bytes(column: Column) -> Column:
    places = F.when(F.octet_length(column) > 0, F.sequence(F.lit(1), F.octet_length(column))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substr(F.hex(column), 2 * i - 1, F.lit(2)), 16, 10))


def typed_key(column: Column, type: Type | None) -> Column:
    """Fixed format: a tag and the value as text; strings carry their byte length, floats their bits in hex, bytes their numbers."""
    if type is None:
        return F.lit("null")
    if type.item:
        return F.coalesce(F.concat(F.lit("list:["), F.array_join(F.transform(column, lambda x: F.concat(typed_key(x, type.item), F.lit(","))), ""), F.lit("]")), F.lit("null"))
    text = {
        "Bool": lambda: F.concat(F.lit("bool:"), column.cast("string")), "I64": lambda: F.concat(F.lit("i64:"), column.cast("string")),
        "U64": lambda: F.concat(F.lit("u64:"), column.cast("string")), "Entity": lambda: F.concat(F.lit("entity:"), column.cast("string")),
        "F64": lambda: F.concat(F.lit("f64:"), bits(column)),
        "String": lambda: F.concat(F.lit("string:"), F.octet_length(column).cast("string"), F.lit(":"), column),
        "Bytes": lambda: F.concat(F.lit("bytes:["), F.array_join(_bytes(column), ", "), F.lit("]")),
    }[type.name]()
    return F.coalesce(text, F.lit("null"))
