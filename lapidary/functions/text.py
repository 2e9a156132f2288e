"""Text repair as columns. What Spark has no function for runs in Arrow-batched
functions, and only on values that a native test marks."""

from __future__ import annotations

import difflib
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

# Python workers get this module's functions by value, so executors need no installation of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def null_hidden(c: Column) -> Column:
    """Null for strings that mean null."""
    return F.when(~F.lower(F.trim(c)).isin(C.HIDDEN_NULLS), c)


def plain_space(c: Column) -> Column:
    """Runs of white space of any kind made one space, none at the ends; marks that show nothing removed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\\uFFFD\\u200B\\u00AD]", ""), r"(?U)\s+", " "))


def repaired(text: str) -> str:
    """UTF-8 read as a Western code page, read anew where that shortens it; then composed form."""
    for page in ("cp1252", "latin-1"):
        try:
            new = text.encode(page).decode("utf-8")
        except UnicodeError:
            continue
        if len(new) < len(text):
            text = new
            break
    return unicodedata.normalize("NFC", text)


def unicode_repair(c: Column) -> Column:
    """Mojibake repair and NFC; ASCII values never leave the JVM."""

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        return s.map(repaired, na_action="ignore")

    odd = c.rlike(r"[^\x00-\x7F]")
    return F.when(odd, fix(F.when(odd, c))).otherwise(c)


def title(c: Column) -> Column:
    """Every run of letters starts in upper case. Letters, digits apart and spaces take the
    native way; other values (apostrophes, hyphens, letters after digits) the Arrow one."""

    @F.pandas_udf("string")
    def slow(s: pd.Series) -> pd.Series:
        return s.str.title()

    simple = c.rlike(r"^[A-Za-z]*([ ]+[A-Za-z]+|[ ]+[0-9]+(?=[ ]|$))*[ ]*$")
    return F.when(simple, F.initcap(c)).when(c.isNotNull(), slow(F.when(~simple, c)))


def expand_state(c: Column, states: dict[str, str] = C.STATES) -> Column:
    """A state's abbreviation as whole value or last word, written out."""
    table = F.create_map(*[F.lit(x) for pair in states.items() for x in pair])
    words = F.split(c, " ")
    whole = F.try_element_at(table, F.lower(c))
    last = F.try_element_at(table, F.lower(F.element_at(words, -1)))
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.coalesce(whole, F.when((F.size(words) > 1) & last.isNotNull(), F.concat(head, F.lit(" "), last)), c)


def closest(values: list[str], known: list[str], cutoff: float) -> dict[str, str]:
    """For each value the most similar known one, where there is one of `cutoff` or more."""
    found = ((v, difflib.get_close_matches(v, known, n=1, cutoff=cutoff)) for v in values)
    return {v: m[0] for v, m in found if m and m[0] != v}


def city(c: Column, known: list[str] = C.CITIES, cutoff: float = 0.8) -> Column:
    """Spelling of known cities; values are compared once per Arrow batch and distinct value."""

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        table = closest([v for v in s.dropna().unique() if v not in known], known, cutoff)
        return s.map(lambda v: table.get(v, v), na_action="ignore")

    sure = c.isNull() | c.isin(known) | (F.length(c) > 40)
    return F.when(sure, c).otherwise(fix(F.when(~sure, c)))


def phone(c: Column) -> Column:
    """Digits and + only; null if none is left."""
    return F.nullif(F.regexp_replace(c, r"[^\d+]", ""), F.lit(""))


def email(c: Column) -> Column:
    """Trimmed; null unless it starts as an address does; blank stays."""
    t = F.trim(c)
    return F.when((t == "") | t.rlike("^" + C.PII["email"]), t)


def digit_share(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\d")) / F.greatest(F.length(c), F.lit(1))


def mask(c: Column, kind: str, how: str = "redact") -> Column:
    """Personal data of a kind replaced by a tag, its SHA-256 (whole value), or all but the last four characters starred."""
    pattern = C.PII[kind]
    if how == "redact":
        return F.regexp_replace(c, pattern, f"[{kind.upper()}]")
    if how == "hash":
        return F.when(c.rlike(pattern), F.sha2(c, 256)).otherwise(c)
    hidden = F.concat(F.repeat(F.lit("*"), F.greatest(F.length(c) - 4, F.lit(0))), F.substring(c, F.greatest(F.length(c) - 3, F.lit(1)), F.lit(4)))
    return F.when(c.rlike(pattern), hidden).otherwise(c)


def strip_html(c: Column) -> Column:
    bare = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def strip_emoji(c: Column) -> Column:
    """Without pictographs, their joiners and variation marks."""
    return F.regexp_replace(c, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]", "")


def decoded_base64(c: Column) -> Column:
    """UTF-8 text of valid base64, else null."""
    return F.try_to_binary(c, F.lit("base64")).cast("string")


def log_field(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
