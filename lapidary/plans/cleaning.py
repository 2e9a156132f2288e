"""The cleaning plan: fitted once from profiles, stored as plain data, applied as projections.

Order of the steps: types, units, text, de-duplication, outliers, rules, nulls,
narrowing; then the whole-table pass: de-duplication, categories, business
rules, null audit. Statistics are those of the whole table, so results do not
depend on how it is partitioned.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import convert, names, text
from ..operators import categories, impute, numbers, rows, rules
from ..operators.quantiles import quantiles
from . import profile as P


@dataclass
class Config:
    """What a caller may change; defaults are the usual run."""

    na_first: bool = False  # hidden nulls become null before types are judged
    dedup_subset: list[str] | None = None
    dedup_keep: str | bool = "first"
    outlier_method: str = "iqr"
    outlier_action: str = "clip"
    constraints: dict[str, dict] = field(default_factory=lambda: dict(C.CONSTRAINTS))
    constraint_match: str = "token"
    null_strategy: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=lambda: {"numeric": "median", "text": "mode", "time": "ffill"})
    fuzzy: bool = False
    custom_rules: dict[str, dict] = field(default_factory=dict)
    skip_null_audit: bool = False
    strict_epoch: bool = False


@dataclass
class Plan:
    """What was decided; serialisable."""

    types: dict[str, str] = field(default_factory=dict)
    rates: dict[str, float] = field(default_factory=dict)
    categories: list[str] = field(default_factory=list)
    bounds: dict[str, list] = field(default_factory=dict)
    fills: dict[str, object] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps(asdict(self), default=str, sort_keys=True)


MAKERS = {
    "bool": convert.boolean,
    "currency": convert.currency,
    "percent": convert.percent,
    "date": convert.timestamp,
    "number": convert.number,
    "weight": convert.grams,
    "time": convert.seconds,
    "id": lambda c: c.cast("string"),
    "epoch": lambda c: F.timestamp_seconds(c),
}


def decide_type(name: str, rates: dict) -> tuple[str, float] | None:
    """The first kind in order whose share passes its gate, and that nine tenths convert to."""
    if names.is_id(name):
        return "id", 1.0
    gates = [("bool", C.BOOL_RATE), ("currency", C.PATTERN_RATE), ("percent", C.PATTERN_RATE), ("date", C.DATE_RATE), ("number", C.NUMBER_RATE)]
    for kind, gate in gates:
        looks, makes = rates[kind]["looks"], rates[kind]["makes"]
        passes = looks > gate if kind in ("bool", "currency", "percent") else looks >= gate
        if passes and makes >= C.SUCCESS:
            return kind, makes
    for kind in ("weight", "time"):
        if rates[kind]["looks"] > C.PATTERN_RATE:
            return kind, rates[kind]["makes"]
    return None


def fit_types(df: DataFrame, config: Config, plan: Plan, order: str = "") -> DataFrame:
    """Decide and apply types and units; `order` stays as it is."""
    strings = names.of_kind(df, names.is_text)
    if config.na_first and strings:
        df = df.withColumns({c: text.null_hidden(F.col(c)) for c in strings})
    rates = P.text_rates(df, [c for c in strings if not names.is_id(c)])
    made: dict[str, Column] = {}
    for f in df.schema.fields:
        c = f.name
        if c == order:
            continue
        if names.is_text(f.dataType) and not names.is_id(c) and rates[c]["n"]:
            found = decide_type(c, rates[c])
            if found:
                plan.types[c], plan.rates[c] = found
                made[c] = MAKERS[found[0]](F.col(c))
        elif names.is_id(c) and names.is_flat(f.dataType):
            plan.types[c] = "id"
            made[c] = F.col(c).cast("string")
    numeric = [f.name for f in df.schema.fields if names.is_number(f.dataType) and not names.is_id(f.name) and f.name != order]
    numeric += [c for c, k in plan.types.items() if k in ("number", "currency")]
    typed = df.withColumns(made) if made else df
    if numeric:
        got = typed.agg(*[F.struct(F.avg(c).alias("mean"), F.max(c).alias("max")).alias(c) for c in numeric]).first()
        late = {c for c in numeric if got[c]["mean"] is not None and got[c]["mean"] > C.EPOCH_MEAN and not (config.strict_epoch and got[c]["max"] >= 4102444800)}
        for c in late:
            plan.types[c] = "epoch"
        if late:
            typed = typed.withColumns({c: F.timestamp_seconds(c) for c in late})
    return typed


def clean_text(df: DataFrame) -> DataFrame:
    """Repair and white space; then case, cities and states by name."""
    made = {}
    for c in names.of_kind(df, names.is_text):
        v = text.plain_space(text.unicode_repair(F.col(c)))
        low = c.lower()
        if "city" in low:
            v = text.city(v)
        elif "state" in low:
            v = text.expand_state(v)
        if names.name_like(c):
            v = text.title(v)
        elif names.code_like(c):
            v = F.upper(v)
        made[c] = v
    return df.withColumns(made) if made else df


def treat_outliers(df: DataFrame, config: Config, plan: Plan, order: str = "") -> DataFrame:
    """Domain clamp, then bounds; with under 30 rows neither."""
    numeric = [c for c in names.of_kind(df, names.is_number) if not names.skips_outliers(c) and c != order]
    if not numeric or df.limit(C.OUTLIER_ROWS).count() < C.OUTLIER_ROWS:
        return df
    df = df.withColumns({c: numbers.clamp_domain(c, config.constraints, config.constraint_match) for c in numeric})
    found = numbers.bounds(df, numeric, config.outlier_method)
    plan.bounds = {c: [b.low, b.high, b.median] for c, b in found.items()}
    return numbers.treat_outliers(df, found, config.outlier_action)


def fill_nulls(df: DataFrame, config: Config, plan: Plan, order: str) -> DataFrame:
    """Hidden nulls, then per column the strategy asked for or its class's default; one statistics job."""
    strings = [c for c in names.of_kind(df, names.is_text) if c != order]
    if strings:
        df = df.withColumns({c: text.null_hidden(F.col(c)) for c in strings})
    kinds = {f.name: f.dataType for f in df.schema.fields if names.is_flat(f.dataType) and f.name != order}
    how = {}
    for c, k in kinds.items():
        kind = "numeric" if names.is_number(k) else "time" if names.is_time(k) else "text"
        how[c] = config.null_strategy.get(c, config.defaults[kind])
    drops = [c for c, h in how.items() if h == "drop"]
    if drops:
        df = df.dropna(subset=drops)
    aggs = [F.count_if(F.col(c).isNull()).alias(f"nulls\u001f{c}") for c in kinds]
    for c, k in kinds.items():
        if names.is_number(k) and how[c] == "mean":
            aggs.append(F.avg(c).alias(c))
        elif not names.is_number(k) and not names.is_time(k) and how[c] == "mode":
            aggs.append(F.mode(c, True).alias(c))
    if not aggs:
        return df
    got = df.agg(*aggs).first().asDict()
    holes = {c for c in kinds if got[f"nulls\u001f{c}"]}
    middle = [c for c in holes if names.is_number(kinds[c]) and how[c] == "median"]
    got |= {c: v[0] for c, v in quantiles(df, {c: [0.5] for c in middle}).items()}
    fills = {}
    for c in holes:
        k = kinds[c]
        if names.is_number(k):
            if how[c] != "interpolation":
                fills[c] = float(got[c]) if got.get(c) is not None else 0.0
        elif not names.is_time(k):
            if how[c] == "mode":
                value = got.get(c)
                fills[c] = value if value is not None else ("Unknown" if names.is_text(k) else None)
            else:
                fills[c] = "Unknown" if how[c].lower() == "unknown" else how[c]
    fills = {c: v for c, v in fills.items() if v is not None}
    plan.fills = fills
    made = {}
    for c, v in fills.items():
        own = F.col(c)
        if names.is_number(kinds[c]) and float(v).is_integer() and isinstance(kinds[c], T.IntegralType):
            made[c] = F.coalesce(own, F.lit(int(v)).cast(kinds[c]))
        else:
            made[c] = F.coalesce(own.cast("double") if names.is_number(kinds[c]) else own, F.lit(v))
    if made:
        df = df.withColumns(made)
    for c in sorted(holes):
        if names.is_time(kinds[c]):
            df = impute.ordered_fill(df, c, order, "bfill" if how[c] == "bfill" else "ffill")
        elif names.is_number(kinds[c]) and how[c] == "interpolation":
            df = impute.ordered_interpolate(df, c, order)
    return df


def clean(df: DataFrame, config: Config | None = None, order: str = "_row_id") -> tuple[DataFrame, Plan]:
    """The cleaned table, in the order of `order` if df has it, else of a row id given here.

    The frame is cached after each de-duplication, as several statistics jobs read it.
    """
    config, plan = config or Config(), Plan()
    if order not in df.columns:
        df = df.withColumn(order, F.monotonically_increasing_id())
    business = [c for c in df.columns if c != order]
    body = fit_types(df, config, plan, order)
    body = clean_text(body)
    keys = config.dedup_subset or [c for c in business if names.is_flat(body.schema[c].dataType)]
    if keys:
        body = rows.dedup(body, keys, config.dedup_keep, [order])
    body = body.persist()
    body = treat_outliers(body, config, plan, order)
    checked = {f.name: rules.chunk_rule(f.name, f.dataType) for f in body.schema.fields if f.name in business}
    body = body.withColumns(checked) if checked else body
    body = fill_nulls(body, config, plan, order)
    kept = {c for c, k in plan.types.items() if k == "id"}
    body = numbers.narrow(body, [c for c in body.columns if c != order and c not in kept])
    return whole_table(body, config, plan, order), plan


def whole_table(df: DataFrame, config: Config, plan: Plan, order: str) -> DataFrame:
    """De-duplication, category spelling, business rules, null audit."""
    business = [c for c in df.columns if c != order]
    flat = [c for c in business if names.is_flat(df.schema[c].dataType)]
    if flat:
        df = rows.dedup(df, flat, "first", [order])
    profile = P.column_profile(df.select(*flat)) if flat else {}
    strings = [c for c in flat if names.is_text(df.schema[c].dataType)]
    plan.categories = [c for c in strings if profile[c]["rows"] and profile[c]["distinct"] / profile[c]["rows"] < C.CATEGORY_RATIO and profile[c]["distinct"] < C.CATEGORY_MOST]
    for c in strings:
        sensitive = names.is_id(c) or "email" in c.lower() or "phone" in c.lower()
        if c in plan.categories or (config.fuzzy and not sensitive):
            df = categories.standardise(df, c, config.fuzzy and not sensitive)
    made = {f.name: rules.business_rule(f.name, f.dataType, config.custom_rules) for f in df.schema.fields if f.name in business}
    df = df.withColumns(made) if made else df
    return df if config.skip_null_audit else null_audit(df, business)


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """What is still null: medians, `Unknown`, the mode of booleans; times stay null."""
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name in columns}
    numeric = [c for c, k in kinds.items() if names.is_number(k)]
    flags = [c for c, k in kinds.items() if isinstance(k, T.BooleanType)]
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in numeric] + [F.mode(c, True).alias(c) for c in flags]
    got = df.agg(*aggs).first().asDict() if aggs else {}
    numeric = [c for c in numeric if got[c]]
    got |= {c: v[0] for c, v in quantiles(df, {c: [0.5] for c in numeric}).items()}
    made = {c: F.coalesce(F.col(c), F.lit(got[c] if got[c] is not None else 0).cast(kinds[c])) for c in numeric}
    made |= {c: F.coalesce(F.col(c), F.lit(got[c])) for c in flags if got[c] is not None}
    made |= {c: F.coalesce(F.col(c), F.lit("Unknown")) for c, k in kinds.items() if names.is_text(k)}
    return df.withColumns(made) if made else df


def reconcile(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Columns missing and extra against expected names, which are normalised first."""
    want, have = set(names.normalised(expected)), set(df.columns)
    return {"missing": sorted(want - have), "extra": sorted(have - want), "expected": sorted(want), "present": sorted(want & have)}
