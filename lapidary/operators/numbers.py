"""Numeric operators: outliers, domain clamps, scaling, narrowing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import names
from .quantiles import quantiles


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """Null stays null (greatest and least would skip it)."""
    out = F.when(c < F.lit(low), F.lit(low)) if low is not None else None
    if high is not None:
        out = F.when(c > F.lit(high), F.lit(high)) if out is None else out.when(c > F.lit(high), F.lit(high))
    return c if out is None else out.otherwise(c)


def clamp_domain(c: str, rules: dict[str, dict] = C.CONSTRAINTS, match: str = "token") -> Column:
    rule = names.constraint_for(c, rules, match)
    return clip(F.col(c), rule.get("min"), rule.get("max")) if rule else F.col(c)


@dataclass
class Bounds:
    low: float
    high: float
    median: float | None


def bounds(df: DataFrame, columns: list[str], method: str = "iqr") -> dict[str, Bounds]:
    """Outlier bounds of all columns in a few jobs; no spread, no bounds.

    iqr: quartiles -/+ 1.5 ranges; zscore: mean -/+ 3 sample deviations; percentile: 1st and 99th.
    """
    if not columns:
        return {}
    shares = {"iqr": [0.25, 0.75], "zscore": [], "percentile": [0.01, 0.99]}[method]
    got = quantiles(df, {c: [*shares, 0.5] for c in columns})
    if method == "zscore":
        row = df.agg(*[F.array(F.avg(c), F.stddev_samp(c)).alias(c) for c in columns]).first()
        got = {c: [*row[c], got[c][0]] for c in columns}
    out, inf = {}, float("inf")
    for c in columns:
        a, b, middle = got[c]
        if a is None or b is None:
            low, high = -inf, inf
        elif method == "iqr":
            low, high = (a - C.IQR_FACTOR * (b - a), b + C.IQR_FACTOR * (b - a)) if b > a else (-inf, inf)
        elif method == "zscore":
            low, high = (a - C.Z_LIMIT * b, a + C.Z_LIMIT * b) if b > 0 else (-inf, inf)
        else:
            low, high = a, b
        out[c] = Bounds(low, high, middle)
    return out


def is_outlier(c: Column, b: Bounds) -> Column:
    """False for null."""
    return F.coalesce((c < F.lit(b.low)) | (c > F.lit(b.high)), F.lit(False))


def treat_outliers(df: DataFrame, found: dict[str, Bounds], action: str = "clip") -> DataFrame:
    """clip to the bounds, replace by the median, flag in <c>_outlier, or remove the rows that hold any."""
    if action == "remove":
        any_mask = F.lit(False)
        for c, b in found.items():
            any_mask = any_mask | is_outlier(F.col(c), b)
        return df.where(~any_mask)
    if action == "flag":
        return df.withColumns({f"{c}_outlier": is_outlier(F.col(c), b) for c, b in found.items()})
    if action == "replace":
        return df.withColumns({c: F.when(is_outlier(F.col(c), b), F.lit(b.median)).otherwise(F.col(c)) for c, b in found.items()})
    finite = lambda x: None if x in (float("inf"), float("-inf")) else x
    return df.withColumns({c: clip(F.col(c), finite(b.low), finite(b.high)) for c, b in found.items()})


@dataclass
class Scaler:
    """Min-max, standard or robust scaling; parameters are plain numbers, so a fitted one can be stored."""

    method: str = "minmax"
    suffix: str = "_scaled"
    params: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> Scaler:
        columns = columns or self.choose(df)
        if self.method == "robust":
            found = quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
            self.params = {c: (m or 0.0, (b or 0.0) - (a or 0.0)) for c, (a, m, b) in found.items()}
            return self
        made = {
            "minmax": lambda v: F.array(F.min(v), F.max(v) - F.min(v)),
            "standard": lambda v: F.array(F.avg(v), F.stddev_samp(v)),
        }[self.method]
        if columns:
            got = df.agg(*[made(F.col(c).cast("double")).alias(c) for c in columns]).first()
            self.params = {c: (float(got[c][0] or 0.0), float(got[c][1] or 0.0)) for c in columns}
        return self

    @staticmethod
    def choose(df: DataFrame) -> list[str]:
        """Numeric columns that are neither ids by name nor 0/1 flags."""
        some = [c for c in names.of_kind(df, names.is_number) if not names.is_bi_id(c)]
        if not some:
            return []
        got = df.agg(*[F.max(F.when(~F.col(c).isin(0, 1), F.lit(1))).alias(c) for c in some]).first()
        return [c for c in some if got[c]]

    def transform(self, df: DataFrame) -> DataFrame:
        """No spread gives 0."""
        scaled = lambda c, a, d: F.when(F.col(c).isNotNull(), F.lit(0.0) if not d else (F.col(c) - F.lit(a)) / F.lit(d))
        return df.withColumns({c + self.suffix: scaled(c, a, d) for c, (a, d) in self.params.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        """Values from scaled columns, which are dropped."""
        back = {c: F.col(c + self.suffix) * F.lit(d) + F.lit(a) for c, (a, d) in self.params.items()}
        out = df.withColumns(back)
        return out.drop(*[c + self.suffix for c in self.params]) if self.suffix else out


def narrow(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Whole numbers in the narrowest of byte, short, int that holds them; doubles of whole numbers
    likewise, other doubles as float where no value changes by over 0.0005."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    some = [c for c in columns or df.columns if isinstance(kinds[c], T.IntegralType | T.FloatType | T.DoubleType)]
    if not some:
        return df
    aggs = []
    for c in some:
        v = F.col(c)
        whole = F.bool_and(v == F.floor(v)) if not isinstance(kinds[c], T.IntegralType) else F.lit(True)
        near = F.bool_and(F.abs(v.cast("float").cast("double") - v) <= 5e-4) if isinstance(kinds[c], T.DoubleType) else F.lit(False)
        aggs.append(F.struct(F.min(v), F.max(v), whole, near).alias(c))
    got, out = df.agg(*aggs).first(), {}
    for c in some:
        low, high, whole, near = got[c]
        if low is None:
            continue
        if whole:
            to = next((t for t, m in (("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31), ("bigint", 1 << 63)) if -m <= low and high < m), None)
        else:
            to = "float" if near else None
        if to:
            out[c] = F.col(c).cast(to)
    return df.withColumns(out) if out else df
