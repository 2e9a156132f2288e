"""Column names: cleaning, and the semantic classes that names and types imply."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .constants import CONSTRAINTS


def normalise(name: str) -> str:
    """Lower case, other characters than a-z, 0-9 and _ made one _, 64 at most; `col` if nothing is left."""
    name = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", name.strip().lower())).strip("_")[:64]
    return name or "col"


def unique(names: list[str]) -> list[str]:
    """Repeated names numbered _1, _2, ..., passing over names that are taken."""
    taken, seen, out = set(names), {}, []
    for n in names:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        while True:
            seen[n] += 1
            new = f"{n}_{seen[n]}"
            if new not in taken:
                break
        taken.add(new)
        out.append(new)
    return out


def normalised(names: list[str]) -> list[str]:
    return unique([normalise(n) for n in names])


def bi_name(name: str) -> str:
    """A name for BI tools: spaces to _, no $ % # ( ), case kept, 64 at most."""
    name = re.sub(r"[$%#()]", "", name.strip().replace(" ", "_"))
    return re.sub(r"_+", "_", name).strip("_")[:64] or "col"


def has_token(name: str, token: str) -> bool:
    """token stands in name between underscores or ends."""
    return re.search(rf"(?:^|_){re.escape(token)}(?:_|$)", name.lower()) is not None


def rule_for(name: str, rules: dict[str, dict]) -> dict | None:
    """The rule of the whole name, else of the first token found."""
    low = name.lower()
    if low in rules:
        return rules[low]
    return next((r for k, r in rules.items() if has_token(low, k)), None)


def constraint_for(name: str, rules: dict[str, dict] = CONSTRAINTS, match: str = "token") -> dict | None:
    low = name.lower()
    hit = (lambda k: k in low) if match == "substring" else (lambda k: has_token(low, k))
    return next((r for k, r in rules.items() if hit(k)), None)


def is_id(name: str) -> bool:
    """By the name's end or start; such columns become strings."""
    low = name.strip().lower()
    return low.endswith(("_id", "_code", "_key", "id", "code", "key")) or low.startswith(("id_", "code_", "key_"))


def skips_outliers(name: str) -> bool:
    return any(w in name.lower() for w in ("id", "code", "key", "zip", "postal", "phone", "aadhaar", "pan", "ssn"))


def is_bi_id(name: str) -> bool:
    return re.search(r"(id|_id|key|code|number|phone|zip|postal|email)", name, re.I) is not None


def is_relation_key(name: str) -> bool:
    return re.search(r"(id|_id|key|code)", name, re.I) is not None


def is_geo(name: str) -> bool:
    return re.search(r"(city|country|state|lat|lon|latitude|longitude|location|address)", name, re.I) is not None


def name_like(name: str) -> bool:
    return any(w in name.lower() for w in ("name", "city", "country", "state", "location", "address"))


def code_like(name: str) -> bool:
    return any(w in name.lower() for w in ("code", "id", "sku", "zip", "postal"))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType)


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_flat(kind: T.DataType) -> bool:
    """Neither array, map, struct nor binary: operators pass those through."""
    return is_number(kind) or is_time(kind) or is_text(kind) or isinstance(kind, T.BooleanType)


def of_kind(df, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]
