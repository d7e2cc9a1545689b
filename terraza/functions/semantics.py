"""Column functions with exact rules for rounding, text and geography, and the DuckDB SQL that gives the same values.

Each function of a column has a twin ending in _sql that takes and returns SQL text, so that a query and its SQL share one
definition of every rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
EARTH_M = 6371008.8  #: mean radius, metres
# Latin letters with marks and what they are without.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: Column | str, digits: int) -> Column:
    """Half away from zero with a relative tolerance; null where the scaled value is not finite."""
    x, f = _column(x).cast("double"), float(10**digits)
    scaled = F.abs(x) * f
    out = F.signum(x) * F.floor(scaled + 0.5 + EPS * F.greatest(F.lit(1.0), scaled)).cast("double") / f
    return F.when(scaled < 1e15, out)


def half_up_sql(x: str, digits: int) -> str:
    f, v = f"{10**digits}.0e0", f"CAST({x} AS DOUBLE)"
    return f"(CASE WHEN abs({v}) * {f} < 1e15 THEN sign({v}) * floor(abs({v}) * {f} + 0.5e0 + {EPS!r} * greatest(1e0, abs({v}) * {f})) / {f} END)"


def round_js(x: Column | str, digits: int) -> Column:
    """Ties go to plus infinity."""
    x, f = _column(x).cast("double"), float(10**digits)
    return F.floor((x + EPS) * f + 0.5).cast("double") / f


def round_js_sql(x: str, digits: int) -> str:
    f = f"{10**digits}.0e0"
    return f"(floor((CAST({x} AS DOUBLE) + {EPS!r}) * {f} + 0.5e0) / {f})"


def round_away(x: Column | str, digits: int) -> Column:
    """Ties go away from zero."""
    x, f = _column(x).cast("double"), float(10**digits)
    return F.signum(x) * F.floor((F.abs(x) + EPS) * f + 0.5).cast("double") / f


def round_away_sql(x: str, digits: int) -> str:
    f, v = f"{10**digits}.0e0", f"CAST({x} AS DOUBLE)"
    return f"(sign({v}) * floor((abs({v}) + {EPS!r}) * {f} + 0.5e0) / {f})"


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_sql(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def clean(x: Column | str) -> Column:
    """White space collapsed and trimmed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(_column(x), r"[ \t\r\n\f\x0b]+", " ")), F.lit(""))


def clean_sql(x: str) -> str:
    return rf"nullif(trim(regexp_replace({x}, '[ \t\r\n\f\v]+', ' ', 'g')), '')"


def unaccent(x: Column | str) -> Column:
    return F.translate(_column(x), ACCENTED, PLAIN)


def unaccent_sql(x: str) -> str:
    return f"translate({x}, '{ACCENTED}', '{PLAIN}')"


def words(x: Column | str) -> Column:
    """Without marks, lower case, everything but letters and digits a single space."""
    return F.trim(F.regexp_replace(F.lower(unaccent(x)), "[^a-z0-9]+", " "))


def words_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({unaccent_sql(x)}), '[^a-z0-9]+', ' ', 'g'))"


def slug(x: Column | str) -> Column:
    """Words joined by dashes; unknown if there are none."""
    return F.coalesce(F.nullif(F.replace(words(x), F.lit(" "), F.lit("-")), F.lit("")), F.lit("unknown"))


def slug_sql(x: str) -> str:
    return f"coalesce(nullif(replace({words_sql(x)}, ' ', '-'), ''), 'unknown')"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null if a coordinate is."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(CASE WHEN {h} IS NOT NULL THEN 2 * {EARTH_M}e0 * asin(least(1e0, sqrt({h}))) END)"


def valid_coordinate(lat: Column, lon: Column) -> Column:
    """In range and not the origin; false for nulls."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def valid_coordinate_sql(lat: str, lon: str) -> str:
    return f"coalesce({lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180 AND NOT ({lat} = 0 AND {lon} = 0), false)"


def reasons(**conditions: Column) -> Column:
    """The names of the conditions that hold, in the order given; a null condition doesn't hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in conditions.items())))


def reasons_sql(**conditions: str) -> str:
    return f"list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in conditions.items())}], lambda r: r IS NOT NULL)"
