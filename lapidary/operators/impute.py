"""Imputation: constants from statistics, and fills along an order.

Fills along an order come in two forms. With groups, plain windows do. Over a
whole table, `ordered_fill` and `interpolate` avoid the single-task window:
rows are cut into ranges of the order column, windows run per range, and what crosses
a border is carried by a table of one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles


def fill(columns: dict[str, object]) -> dict[str, Column]:
    """Null replaced by a value per column."""
    return {c: F.coalesce(F.col(c), F.lit(v)) for c, v in columns.items()}


def numeric_fill(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """Median or mean per column, 0.0 where all is null; any other word means 0.0."""
    if not columns:
        return df
    got = None
    if how == "median":
        got = {c: v[0] for c, v in quantiles(df, {c: [0.5] for c in columns}).items()}
    elif how == "mean":
        got = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(got[c]) if got and got[c] is not None else 0.0)) for c in columns})


def text_fill(df: DataFrame, columns: list[str], how: str = "mode") -> DataFrame:
    """The mode (of equals the least), `Unknown` where there is none or for how="unknown", else the given word itself."""
    if not columns:
        return df
    if how == "mode":
        got = df.agg(*[F.mode(c, True).alias(c) for c in columns]).first()
        kinds = dict(df.dtypes)
        values = {c: got[c] if got[c] is not None else ("Unknown" if kinds[c] == "string" else None) for c in columns}
    else:
        values = dict.fromkeys(columns, "Unknown" if how.lower() == "unknown" else how)
    return df.withColumns(fill({c: v for c, v in values.items() if v is not None}))


def drop_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def _fills(c: Column, before, after, first: str) -> Column:
    last, nxt = F.last(c, True).over(before), F.first(c, True).over(after)
    return F.coalesce(last, nxt) if first == "ffill" else F.coalesce(nxt, last)


def group_fill(df: DataFrame, column: str, group: list[str], order: list[str], first: str = "ffill", out: str | None = None) -> DataFrame:
    """Forward then backward fill within groups, or (first="bfill") the other way round."""
    w = W.partitionBy(*group).orderBy(*order)
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    return df.withColumn(out or column, _fills(F.col(column), before, after, first))


def group_interpolate(df: DataFrame, column: str, group: list[str], order: list[str], out: str | None = None, edge: float = 0.0) -> DataFrame:
    """Linear by position within groups; outer nulls take the nearest value, groups without any `edge`.
    Timestamps interpolate in microseconds and stay null where there is none."""
    w = W.partitionBy(*group).orderBy(*order)
    time = dict(df.dtypes)[column] in ("timestamp", "timestamp_ntz")
    value = F.unix_micros(F.col(column).cast("timestamp")) if time else F.col(column).cast("double")
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_v", value)
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_v").alias("v")))
    rows = rows.withColumns(
        {
            "_p": F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "_n": F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    span = F.col("_n.i") - F.col("_p.i")
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.try_divide(F.col("_i") - F.col("_p.i"), span)
    got = F.coalesce(F.col("_v"), line, F.col("_p.v"), F.col("_n.v"))
    got = F.timestamp_micros(got.cast("long")).cast(dict(df.dtypes)[column]) if time else F.coalesce(got, F.lit(edge))
    return rows.withColumn(out or column, got).drop("_i", "_v", "_p", "_n")


def _ranges(df: DataFrame, order: str, range_rows: int) -> DataFrame | None:
    """df with _range, ranges of equal width of the numeric column `order`; None for an empty table."""
    count, low, high = df.agg(F.count(F.lit(1)), F.min(order), F.max(order)).first()
    if not count:
        return None
    many = max(1, count // range_rows)
    width = (high - low) / many or 1
    return df.withColumn("_range", F.least(F.floor((F.col(order) - low) / F.lit(width)), F.lit(many - 1)).cast("int"))


def ordered_interpolate(df: DataFrame, column: str, order: str, edge: float = 0.0, range_rows: int = 100_000) -> DataFrame:
    """group_interpolate over the whole table by the unique numeric column `order`, range by range.

    Positions and the nearest known values outside a range come from a table with one row per range.
    """
    placed = _ranges(df, order, range_rows)
    if placed is None:
        return df
    kind = dict(df.dtypes)[column]
    time = kind in ("timestamp", "timestamp_ntz")
    value = F.unix_micros(F.col(column).cast("timestamp")) if time else F.col(column).cast("double")
    w = W.partitionBy("_range").orderBy(order)
    rows = placed.withColumn("_v", value).withColumn("_i", F.row_number().over(w).cast("long"))
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_v").alias("v")))
    rows = rows.withColumns(
        {
            "_p": F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "_n": F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    ends = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), F.min(known).alias("_f"), F.max(known).alias("_l"))
    line = W.partitionBy(F.lit(0)).orderBy("_range")  # one row per range
    earlier, later = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(1, W.unboundedFollowing)
    ends = ends.withColumn("_off", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    moved = lambda c, off: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.i") + F.col(off)).alias("i"), F.col(f"{c}.v").alias("v")))
    ends = ends.select("_range", "_off", F.last(moved("_l", "_off"), True).over(earlier).alias("_before"), F.first(moved("_f", "_off"), True).over(later).alias("_after"))
    rows = rows.join(ends, "_range", "left")
    p, n = F.coalesce(moved("_p", "_off"), F.col("_before")), F.coalesce(moved("_n", "_off"), F.col("_after"))
    rows = rows.withColumns({"_a": p, "_b": n})
    at = F.col("_i") + F.col("_off")
    line_value = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.try_divide(at - F.col("_a.i"), F.col("_b.i") - F.col("_a.i"))
    got = F.coalesce(F.col("_v"), line_value, F.col("_a.v"), F.col("_b.v"))
    got = F.timestamp_micros(got.cast("long")).cast(kind) if time else F.coalesce(got, F.lit(edge))
    return rows.withColumn(column, got).select(*df.columns)


def ordered_fill(df: DataFrame, column: str, order: str, first: str = "ffill", range_rows: int = 100_000) -> DataFrame:
    """Forward then backward fill (or the other way round) over the whole table by the unique numeric column `order`.

    Ranges of `order` are filled by themselves; the last known value before and
    the first after each range come from a table with one row per range.
    """
    placed = _ranges(df, order, range_rows)
    if placed is None:
        return df
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("o"), F.col(column).alias("v")))
    ends = placed.groupBy("_range").agg(F.min(known)["v"].alias("_f"), F.max(known)["v"].alias("_l"))
    line = W.partitionBy(F.lit(0)).orderBy("_range")  # one row per range
    ends = ends.select(
        "_range",
        F.last("_l", True).over(line.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_f", True).over(line.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    w = W.partitionBy("_range").orderBy(order)
    back = F.last(column, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    forth = F.first(column, True).over(w.rowsBetween(0, W.unboundedFollowing))
    rows = placed.withColumns({"_back": back, "_forth": forth}).join(ends, "_range", "left")
    left, right = F.coalesce("_back", "_before"), F.coalesce("_forth", "_after")
    filled = F.coalesce(left, right) if first == "ffill" else F.coalesce(right, left)
    return rows.withColumn(column, filled).select(*df.columns)
