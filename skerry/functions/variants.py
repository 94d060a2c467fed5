"""JSON as VARIANT values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named: within
    functions over lists Spark works out every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_object(value: Column) -> Column:
    """Whether the value is an object, told without a copy of its members."""
    return F.try_variant_get(value, "$", "struct<`3`:variant>").isNotNull()


def member(node: Column | str, name: str, kind: str = "variant") -> Column:
    """A member of an object, as ``kind``; null without it or if it is of another kind."""
    return F.try_variant_get(node, f"$['{name}']", kind)


def string(value: Column) -> Column:
    """The value if it is a string: other kinds aren't turned into one."""
    return once(value, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")))


def whole_json(text: Column) -> Column:
    """The text as a VARIANT; null if it isn't JSON to its end.  A parser that stops
    after the first value can't overlook what follows both in a list and in an object."""
    listed, named = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(listed.isNotNull(), member(named, "v"))
