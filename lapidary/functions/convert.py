"""Text to typed values, as columns that never raise: what does not convert is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CURRENCY = r"^\s*[₹$€£]\s*\d|^\s*\d+.*\s*[₹$€£]\s*$"
PERCENT = r"^\s*[\d.]+\s*%\s*$"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def number(c: Column) -> Column:
    """A plain decimal number; 1d, 12f, nan and inf are none."""
    t = trimmed(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def boolean(c: Column) -> Column:
    t = F.lower(trimmed(c))
    return F.when(t.isin(C.TRUE_WORDS), F.lit(True)).when(t.isin(C.FALSE_WORDS), F.lit(False))


def looks_boolean(c: Column) -> Column:
    return F.lower(trimmed(c)).isin(C.TRUE_WORDS + C.FALSE_WORDS)


def currency(c: Column) -> Column:
    return number(F.regexp_replace(c, r"[₹$€£,\s]", ""))


def percent(c: Column) -> Column:
    return number(F.regexp_replace(c, r"[%\s]", "")) / 100


def timestamp(c: Column, patterns: list[str] = C.DATE_PATTERNS) -> Column:
    """By the first pattern that fits; month before day where both fit; times of day alone are null."""
    t = trimmed(c)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in patterns])


def _units(c: Column, units: dict[str, float]) -> tuple[Column, Column]:
    names = "|".join(sorted(units, key=lambda u: (-len(u), u)))
    pattern = rf"(?i)^\s*([\d.]+)\s*({names})s?\s*$"
    factor = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    value = F.regexp_extract(c, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    scaled = F.when(c.rlike(pattern), value * F.try_element_at(factor, unit))
    return c.rlike(pattern), F.coalesce(scaled, number(c))


def grams(c: Column) -> Column:
    """Weights in grams; bare numbers are kept."""
    return _units(c, C.GRAMS)[1]


def seconds(c: Column) -> Column:
    """Times in seconds; bare numbers are kept."""
    return _units(c, C.SECONDS)[1]


def has_weight(c: Column) -> Column:
    return _units(c, C.GRAMS)[0]


def has_time(c: Column) -> Column:
    return _units(c, C.SECONDS)[0]
