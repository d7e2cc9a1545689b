"""Paths into nested columns, compiled to higher-order functions.

A path is a chain of fields: `a.b.c`. Behind a field, `[]` takes the elements of an array, and `[x]` those that are records with a string
field that is x. The result is an array of all values found, as there may be many. A field that the schema lacks, or that a null
record would have, is null; brackets behind something that is no array find nothing, and so does a path that can't be read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SEGMENT = re.compile(r"(?P<field>[^\[\]]+)(?P<brackets>\[(?P<value>[^\]]*)\])?")


def _field(name: str) -> Callable[[Column], Column]:
    return lambda record: record[name]


def _holds(kind: T.StructType, value: str) -> Callable[[Column], Column]:
    """Whether a record, of that type and not null, has a string field that is value."""
    strings = [f.name for f in kind.fields if isinstance(f.dataType, T.StringType)]
    return lambda record: F.coalesce(record.isNotNull() & F.array_contains(F.array_compact(F.array(*(record[n] for n in strings), F.lit(None).cast("string"))), value), F.lit(False))


def compiled(path: str, root: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """The array of values at path in root, whose type is kind, and the type of its elements."""
    values, element = F.array(root), kind
    nothing = (F.array().cast("array<string>"), T.StringType())
    for segment in path.split("."):
        m = _SEGMENT.fullmatch(segment)
        if not m:
            return nothing
        field = next((f.dataType for f in element.fields if f.name == m["field"]), None) if isinstance(element, T.StructType) else None
        if field is None:
            if m["brackets"]:
                return nothing
            values, element = F.transform(values, lambda v: F.lit(None).cast("string")), T.StringType()
            continue
        values, element = F.transform(values, _field(m["field"])), field
        if m["brackets"]:
            if not isinstance(element, T.ArrayType):
                return nothing
            values, element = F.flatten(F.filter(values, lambda v: v.isNotNull())), element.elementType
            if m["value"]:
                if not isinstance(element, T.StructType):
                    return nothing
                values = F.filter(values, _holds(element, m["value"]))
    return values, element


def at(path: str, root: str, schema: T.StructType) -> Column:
    """The values at path in the column root of a table with that schema; a path may begin with the fields of root."""
    return compiled(path, F.col(root), schema[root].dataType)[0]
