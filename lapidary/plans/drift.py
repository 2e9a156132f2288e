"""Schema drift against stored snapshots."""

from __future__ import annotations

import difflib
import json
import os
import time
import warnings

from pyspark.sql import DataFrame

from ..functions import names


class SchemaDriftWarning(UserWarning):
    """Raised as a warning where a numeric column turned into another kind or back."""


def snapshot(df: DataFrame) -> dict:
    return {"columns": {f.name: f.dataType.simpleString() for f in df.schema.fields}, "created_at": time.time()}


def _numeric(kind: str) -> bool:
    return kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))


def compare(old: dict[str, str], new: dict[str, str], likeness: float = 0.80) -> dict:
    """New, removed and renamed columns (one to one, most alike first) and changed types with their risk."""
    gone, come = [c for c in old if c not in new], [c for c in new if c not in old]
    pairs = sorted(
        ((difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio(), a, b) for a in gone for b in come),
        key=lambda x: (-x[0], x[1], x[2]),
    )
    renamed, used = {}, set()
    for score, a, b in pairs:
        if score >= likeness and a not in renamed and b not in used:
            renamed[a] = b
            used.add(b)
    changed = {c: {"from": old[c], "to": new[c], "risk": "HIGH" if _numeric(old[c]) != _numeric(new[c]) else "LOW"} for c in old if c in new and old[c] != new[c]}
    out = {
        "new_columns": [c for c in come if c not in used],
        "removed_columns": [c for c in gone if c not in renamed],
        "renamed_columns": renamed,
        "changed_types": changed,
    }
    return {"drift_detected": any(out.values())} | out


def detect(df: DataFrame, path: str, update: bool = False, likeness: float = 0.80) -> dict:
    """Compare df with the snapshot at a driver-local path; without one, write it and report none."""
    now = snapshot(df)
    if not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            json.dump(now, f, indent=2)
        return compare(now["columns"], now["columns"]) | {"first_run": True}
    with open(path, encoding="utf-8") as f:
        before = json.load(f)["columns"]
    found = compare(before, now["columns"], likeness) | {"first_run": False}
    high = [c for c, x in found["changed_types"].items() if x["risk"] == "HIGH"]
    if high:
        warnings.warn(f"kind of column changed: {', '.join(high)}", SchemaDriftWarning, stacklevel=2)
    if update:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(now, f, indent=2)
    return found


def compare_normalised(df: DataFrame, expected: list[str]) -> dict:
    return compare(dict.fromkeys(names.normalised(expected), ""), dict.fromkeys(df.columns, ""))
