"""Profiles: every statistic that the steps need, in as few aggregate jobs as possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import convert, names


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_nulls), one row per column, from one job."""
    cols = [c for c in df.columns]
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(_q(c).isNull()).alias("n_nulls")) for c in cols])
    return df.agg(parts.alias("p")).select(F.explode("p").alias("x")).select("x.*")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_distinct) of flat columns, nulls not counted."""
    cols = columns or names.of_kind(df, names.is_flat)
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(_q(c)).alias("n_distinct")) for c in cols])
    return df.agg(parts.alias("p")).select(F.explode("p").alias("x")).select("x.*")


def column_profile(df: DataFrame, exact: bool = False) -> dict[str, dict]:
    """Per flat column: rows, nulls, distinct (approximate by default; exact where under 1,000 or asked for), min, max, mean of numbers."""
    cols = names.of_kind(df, names.is_flat)
    if not cols:
        return {}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    many = F.count_distinct if exact else (lambda c: F.approx_count_distinct(c, 0.02))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        num = names.is_number(kinds[c])
        aggs += [F.count(_q(c)).alias(f"n{i}"), many(_q(c)).alias(f"d{i}")]
        if num:
            aggs.append(F.struct(F.min(_q(c)).cast("double").alias("min"), F.max(_q(c)).cast("double").alias("max"), F.avg(_q(c)).alias("mean")).alias(f"s{i}"))
    got = df.agg(*aggs).first()
    near = [] if exact else [c for i, c in enumerate(cols) if got[f"d{i}"] <= 1_100]
    sure = df.agg(*[F.count_distinct(_q(c)).alias(f"e{i}") for i, c in enumerate(near)]).first() if near else None
    out = {}
    for i, c in enumerate(cols):
        distinct = sure[f"e{near.index(c)}"] if c in near else got[f"d{i}"]
        out[c] = {"rows": got["rows"], "nulls": got["rows"] - got[f"n{i}"], "distinct": distinct}
        if names.is_number(kinds[c]):
            out[c] |= got[f"s{i}"].asDict()
    return out


def text_rates(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Of each string column's values that are not null: the share that looks like or converts to each kind. One job."""
    tests = {
        "bool": (convert.looks_boolean, convert.boolean),
        "currency": (lambda c: c.rlike(convert.CURRENCY), convert.currency),
        "percent": (lambda c: c.rlike(convert.PERCENT), convert.percent),
        "date": (lambda c: convert.timestamp(c).isNotNull(), convert.timestamp),
        "number": (lambda c: convert.number(c).isNotNull(), convert.number),
        "weight": (convert.has_weight, convert.grams),
        "time": (convert.has_time, convert.seconds),
    }
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(F.count(_q(c)).alias(f"n{i}"))
        for k, (looks, makes) in tests.items():
            aggs.append(F.struct(F.count_if(looks(_q(c))).alias("looks"), F.count(makes(_q(c))).alias("makes")).alias(f"{k}{i}"))
    if not aggs:
        return {}
    got, out = df.agg(*aggs).first(), {}
    for i, c in enumerate(columns):
        n = got[f"n{i}"]
        out[c] = {"n": n} | {k: {x: (got[f"{k}{i}"][x] / n if n else 0.0) for x in ("looks", "makes")} for k in tests}
    return out


def duplicate_share(df: DataFrame) -> float:
    """Of all rows, the share that repeats another; digests of the flat columns are compared, pre-aggregated before the shuffle."""
    flat = names.of_kind(df, names.is_flat)
    digest = F.md5(F.concat_ws("\u001f", *[F.coalesce(_q(c).cast("string"), F.lit("\u0000")) for c in flat]))
    n, d = df.agg(F.count(F.lit(1)), F.count_distinct(digest)).first()
    return 1 - d / n if n else 0.0


def risk(share: float) -> str:
    return "High" if share >= 0.10 else "Medium" if share >= 0.02 else "Low"


def complexity(df: DataFrame) -> str:
    if not df.columns:
        return "Unknown"
    share = len(names.of_kind(df, names.is_text)) / len(df.columns)
    return "Complex" if share >= 0.5 else "Mixed" if share > 0 else "Simple"


def size_estimate(df: DataFrame) -> int:
    """Bytes of the values: lengths of strings, fixed widths of the rest. An estimate, from one job."""
    width = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "boolean": 1, "date": 4}
    parts, fixed = [], 0
    for c, kind in df.dtypes:
        if kind == "string":
            parts.append(F.coalesce(F.sum(F.octet_length(_q(c))), F.lit(0)))
        else:
            fixed += width.get(kind, 8)
    got = df.agg(F.count(F.lit(1)).alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
    return got["n"] * (fixed + 8 * len(parts)) + sum(got[f"p{i}"] for i in range(len(parts)))


def corrupted(profile: dict[str, dict]) -> list[str]:
    """Columns of 90 % nulls or more, or of one value over several rows."""
    return [c for c, p in profile.items() if p["rows"] > 1 and (p["nulls"] / p["rows"] >= C.CORRUPT_NULLS or p["distinct"] <= 1)]


def name_issues(columns: list[str]) -> dict[str, list[str]]:
    import re

    low = [c.lower() for c in columns]
    return {
        "spaces": [c for c in columns if " " in c],
        "symbols": [c for c in columns if re.search(r"[^\w\s]", c)],
        "duplicates": [c for c in columns if low.count(c.lower()) > 1],
    }


def pii_rates(df: DataFrame) -> dict[str, dict[str, float]]:
    """Of each string column's values, the share that holds each kind of personal data; kinds of none are left out."""
    cols = names.of_kind(df, names.is_text)
    if not cols:
        return {}
    aggs = [F.avg(_q(c).rlike(p).cast("int")).alias(f"{c}\u001f{k}") for c in cols for k, p in C.PII.items()]
    got = df.agg(*aggs).first()
    return {c: {k: got[f"{c}\u001f{k}"] for k in C.PII if got[f"{c}\u001f{k}"]} for c in cols}


def value_patterns(df: DataFrame, column: str) -> DataFrame:
    """Shapes of values (letters A, digits 9) with counts: mixed shapes tell of mixed sources."""
    shape = F.regexp_replace(F.regexp_replace(_q(column), r"\p{L}+", "A"), r"\d+", "9")
    return df.where(_q(column).isNotNull()).groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))
