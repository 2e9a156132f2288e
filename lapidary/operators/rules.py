"""Validation rules: values that break one become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import names, text


def in_range(c: Column, low=None, high=None, allowed=None) -> Column:
    """c where it is in range and allowed, else null."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= F.lit(low))
    if high is not None:
        ok = ok & (c <= F.lit(high))
    if allowed is not None:
        ok = ok & c.isin(list(allowed))
    return F.when(ok, c)


def matching(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), c)


def few_digits(c: Column, share: float) -> Column:
    """c if at least `share` of its characters are no digits; empty stays."""
    return F.when((F.length(c) == 0) | (1 - text.digit_share(c) >= share), c)


def chunk_rule(name: str, kind: T.DataType, rules: dict[str, dict] = C.COLUMN_RULES) -> Column:
    """The column under the first rule whose token is in its name; as it is if none applies to its type."""
    c, rule = F.col(name), names.constraint_for(name, rules)
    if rule is None:
        return c
    if names.is_number(kind) and ("min" in rule or "max" in rule):
        return in_range(c, rule.get("min"), rule.get("max"))
    if names.is_text(kind) and "pattern" in rule:
        return matching(c, rule["pattern"])
    if names.is_text(kind) and "no_digits_ratio" in rule:
        return few_digits(c, rule["no_digits_ratio"])
    return c


def business_rule(name: str, kind: T.DataType, custom: dict[str, dict] | None = None) -> Column:
    """Ranges and allowed values by whole name or token, address and phone checks by name."""
    c = F.col(name)
    low = name.lower()
    rule = names.rule_for(name, C.CONSTRAINTS | (custom or {}))
    if rule is not None and (names.is_number(kind) or "allowed_values" in rule):
        c = in_range(c, rule.get("min"), rule.get("max"), rule.get("allowed_values"))
    if names.is_text(kind) and "email" in low:
        c = text.email(c)
    elif names.is_text(kind) and any(w in low for w in ("phone", "mobile", "tel")):
        c = text.phone(c)
    return c
