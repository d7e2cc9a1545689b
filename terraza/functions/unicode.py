"""Unicode normal forms, which Spark SQL doesn't have: functions on Arrow batches, with twins that give DuckDB SQL."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from terraza.functions.semantics import _column

MARKS = "[̀-ͯ]"  #: combining marks
PIECE = 1 << 20  #: bytes


def composed(column: pa.Array, form: str) -> pa.Array:
    """Texts in a normal form, PIECE bytes of them, or one, as Python's strings at a time. Arrow's own NFC leaves letters decomposed."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(column)]
    parts = [pa.array([None if x is None else unicodedata.normalize(form, x) for x in column[a:b].to_pylist()], pa.string()) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.concat_arrays(parts)


def normal(x: Column | str, form: str = "NFC") -> Column:
    """A text in a normal form; null stays null."""

    return F.arrow_udf(lambda column: composed(column, form), "string")(_column(x))


def unmarked(x: Column | str) -> Column:
    """A text decomposed and without combining marks: letters of any script are told from their marks, whichever way they were written."""

    def to(column: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(pc.utf8_normalize(column.cast(pa.string()), form="NFD"), MARKS, "")

    return F.arrow_udf(to, "string")(_column(x))


def unmarked_sql(x: str) -> str:
    return f"strip_accents({x})"


def words(x: Column | str) -> Column:
    """Without marks, lower case, everything but ASCII letters and digits a single space."""
    return F.trim(F.regexp_replace(F.lower(unmarked(x)), "[^a-z0-9]+", " "))


def words_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({unmarked_sql(x)}), '[^a-z0-9]+', ' ', 'g'))"
