"""Shaping for BI tools: names, roles, date parts, calculated fields, chart recommendations."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import names
from ..plans import profile as P
from . import categories

HASH = r"^[0-9a-fA-F]{32,64}$"
ISO = r"^\d{4}-\d{2}-\d{2}"


def iso_columns(df: DataFrame) -> list[str]:
    """String columns that have values, all of them ISO dates, over all rows."""
    strings = names.of_kind(df, names.is_text)
    if not strings:
        return []
    got = df.agg(*[F.bool_and(F.col(f"`{c}`").rlike(ISO)).alias(c) for c in strings]).first()
    return [c for c in strings if got[c]]


def bi_names(df: DataFrame) -> DataFrame:
    return df.toDF(*names.unique([names.bi_name(c) for c in df.columns]))


def text_dates(df: DataFrame) -> DataFrame:
    """Times as yyyy-MM-dd HH:mm:ss text."""
    times = names.of_kind(df, names.is_time)
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times}) if times else df


def useless(df: DataFrame) -> list[str]:
    """Columns of over 95 % nulls, or of one value at most over several rows."""
    found = P.column_profile(df)
    return [c for c, p in found.items() if p["rows"] and (p["nulls"] / p["rows"] > C.UNUSED_NULLS or (p["rows"] > 1 and p["distinct"] <= 1))]


def blobs(df: DataFrame) -> list[str]:
    """String columns of long texts (over 250 characters on average) or of hexadecimal hashes, over all rows."""
    strings = names.of_kind(df, names.is_text)
    if not strings:
        return []
    got = df.agg(*[F.struct(F.avg(F.length(c)).alias("long"), F.bool_and(F.col(c).rlike(HASH)).alias("hash")).alias(c) for c in strings]).first()
    return [c for c in strings if (got[c]["long"] or 0) > C.BLOB_CHARS or got[c]["hash"]]


def roles(df: DataFrame) -> dict[str, str]:
    """date, measure or dimension of each flat column."""
    found, iso = P.column_profile(df), set(iso_columns(df))
    out = {}
    for f in df.schema.fields:
        if f.name not in found:
            continue
        p = found[f.name]
        if names.is_time(f.dataType) or f.name in iso:
            out[f.name] = "date"
        elif names.is_number(f.dataType) and not names.is_bi_id(f.name) and p["distinct"] >= min(10, p["rows"]):
            out[f.name] = "measure"
        else:
            out[f.name] = "dimension"
    return out


def prepare(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Names, dates as text, useless columns dropped, rare categories as Other; and the roles."""
    df = text_dates(bi_names(df))
    df = df.drop(*useless(df))
    found = P.column_profile(df)
    for c in names.of_kind(df, names.is_text):
        if found[c]["distinct"] > C.MANY_VALUES:
            df = categories.rare_to_other(df, c)
    return df, roles(df)


def keys_formatted(df: DataFrame) -> DataFrame:
    """Relation keys as trimmed strings, null as empty."""
    keys = [c for c in names.of_kind(df, names.is_flat) if names.is_relation_key(c)]
    return df.withColumns({c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in keys}) if keys else df


def date_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """<c>_Year, _Month, _Day, _Quarter, _WeekDay and _Hour; 0 or Unknown for null."""
    made = {}
    for c in columns:
        t = F.col(c) if names.is_time(df.schema[c].dataType) else F.try_to_timestamp(c)
        for part, f in (("Year", F.year), ("Month", F.month), ("Day", F.dayofmonth), ("Quarter", F.quarter), ("Hour", F.hour)):
            made[f"{c}_{part}"] = F.coalesce(f(t), F.lit(0))
        made[f"{c}_WeekDay"] = F.coalesce(F.date_format(t, "EEEE"), F.lit("Unknown"))
    return df.withColumns(made) if made else df


def power_bi(df: DataFrame) -> tuple[DataFrame, dict]:
    """Keys, date parts, no blobs; and the schema with relation keys, measures, dimensions and dates."""
    dates = names.of_kind(df, names.is_time) + iso_columns(df)
    out = date_parts(keys_formatted(df), dates)
    out = out.drop(*[c for c in blobs(out) if c not in dates])
    found = roles(df.select(*[c for c in df.columns if c in out.columns]))
    pick = lambda r: [c for c, x in found.items() if x == r]
    keys = [c for c in found if names.is_relation_key(c)]
    return out, {"relationships": keys, "measures": pick("measure"), "dimensions": pick("dimension"), "date_columns": [c for c in dates if c in out.columns]}


def aggregation_ready(df: DataFrame) -> DataFrame:
    """Numbers without null as 0.0, strings without null as Unknown and trimmed."""
    made = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in names.of_kind(df, names.is_number)}
    made |= {c: F.trim(F.coalesce(F.col(c), F.lit("Unknown"))) for c in names.of_kind(df, names.is_text)}
    return df.withColumns(made) if made else df


def calculated_fields(columns: list[str]) -> list[dict]:
    """Suggestions by name; of several columns that fit, the last is meant."""
    last = lambda *words: next((c for c in reversed(columns) if any(w in c.lower() for w in words)), None)
    profit, revenue, quantity, price = last("profit"), last("revenue", "sales"), last("qty", "quantity"), last("price")
    out = []
    if profit and revenue:
        out.append({"name": "Profit Margin", "formula": f"SUM([{profit}]) / SUM([{revenue}])"})
    if quantity and price:
        out.append({"name": "Total Value", "formula": f"[{quantity}] * [{price}]"})
    return out


def tableau(df: DataFrame) -> tuple[DataFrame, dict, list[dict]]:
    out = aggregation_ready(df)
    return out, roles(out), calculated_fields(df.columns)


def recommend(df: DataFrame, most: int = 5) -> list[dict]:
    """Charts by rules over roles and distinct counts, most useful first."""
    found, p = roles(df), P.column_profile(df)
    dates = [c for c, r in found.items() if r == "date"]
    measures = [c for c in found if names.is_number(df.schema[c].dataType) and not names.is_bi_id(c)]
    words = [c for c, r in found.items() if r == "dimension" and names.is_text(df.schema[c].dataType)]
    show = lambda c: c.replace("_", " ").title()
    out = []
    if dates and measures:
        out.append({"chart": "Line", "x": dates[0], "y": measures[0], "title": f"{show(measures[0])} over {show(dates[0])}", "priority": "High"})
    geo = [c for c in words if names.is_geo(c)]
    if geo and measures:
        out.append({"chart": "Map", "x": geo[0], "y": measures[0], "title": f"{show(measures[0])} by {show(geo[0])}", "priority": "High"})
    for c in words:
        if measures and p[c]["distinct"] >= 2:
            kind = "Bar" if p[c]["distinct"] <= 10 else "Treemap"
            out.append({"chart": kind, "x": c, "y": measures[0], "title": f"{show(measures[0])} by {show(c)}", "priority": "High" if kind == "Bar" else "Medium"})
            break
    few = [c for c in words if 2 <= p[c]["distinct"] <= 6]
    if few:
        out.append({"chart": "Pie", "x": few[0], "y": measures[0] if measures else None, "title": f"Share of {show(few[0])}", "priority": "Medium"})
    if len(measures) >= 2:
        out.append({"chart": "Scatter", "x": measures[0], "y": measures[1], "title": f"{show(measures[0])} and {show(measures[1])}", "priority": "Medium"})
    if measures:
        out.append({"chart": "KPI", "x": None, "y": measures[0], "title": f"Total {show(measures[0])}", "priority": "Low"})
    rank = {"High": 0, "Medium": 1, "Low": 2}
    return sorted(out, key=lambda x: rank[x["priority"]])[:most]


def write_json(folder: str, name: str, value) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, default=str)
    return path
