"""Row operators: de-duplication, union, probes, orphans, sessions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dedup(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", order: list[str] | None = None) -> DataFrame:
    """One row of each group equal in `subset` (nulls equal): the first or last by `order`, or none of a
    repeated group (keep=False). Without subset or order: plain distinct rows."""
    keys = subset or df.columns
    if subset is None and keep in ("first", "last"):
        return df.dropDuplicates()
    if keep is False:
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        return df.withColumn("_n", n).where("_n = 1").drop("_n")
    by = [F.col(c).desc() if keep == "last" else F.col(c) for c in order or keys]
    return df.withColumn("_turn", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("_turn = 1").drop("_turn")


def row_hash(columns: list[str]) -> Column:
    """MD5 of a row: null counts as empty, and a separator keeps ("a", "bc") and ("ab", "c") apart."""
    return F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def hash_dedup(df: DataFrame, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The first row, by `order`, of each row hash."""
    cols = columns or df.columns
    marked = df.withColumn("_hash", row_hash(cols))
    return dedup(marked, ["_hash"], "first", order or cols).drop("_hash")


def union_all(frames: list[DataFrame], spark=None) -> DataFrame:
    """Rows of all frames; columns that one lacks are null. A column of different types becomes
    the wider number, or string where the types have nothing in common."""
    if not frames:
        if spark is None:
            raise ValueError("an empty union needs a session")
        return spark.createDataFrame([], T.StructType())
    kinds: dict[str, set] = {}
    for f in frames:
        for field in f.schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType)
    mixed = {n for n, k in kinds.items() if len(k) > 1 and not all(isinstance(x, T.NumericType) for x in k)}
    cast = [f.withColumns({n: F.col(n).cast("string") for n in mixed & set(f.columns)}) if mixed & set(f.columns) else f for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    return union_all(frames).dropDuplicates()


def probe(df: DataFrame, column: str, n: int, order: list[str]) -> DataFrame:
    """The first n values that are not null."""
    return df.where(F.col(column).isNotNull()).orderBy(*order).select(column).limit(n)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key no parent has."""
    keys = parent.select(F.col(parent_key).alias("_key")).distinct()
    return child.join(keys, F.col(child_key) == F.col("_key"), "left_anti")


def sessions(df: DataFrame, user: str, time: str, gap_seconds: int, tie: str) -> DataFrame:
    """df with session: numbered from 1 per user, a new one after `gap_seconds` without an event."""
    w = W.partitionBy(user).orderBy(time, tie)
    gap = F.unix_micros(F.col(time)) - F.lag(F.unix_micros(F.col(time))).over(w)
    new = F.when(gap > gap_seconds * 1_000_000, 1).when(gap.isNull(), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def rolling_median(df: DataFrame, group: list[str], order: list[str], column: str, before: int, out: str) -> DataFrame:
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(-before, 0)
    return df.withColumn(out, F.percentile(F.col(column), F.lit(0.5)).over(w))


def where_all(df: DataFrame, rules: dict[str, Callable[[], Column]]) -> DataFrame:
    """df with `broken`: the names of the cross-column rules a row breaks (null results break none)."""
    named = [F.when(~test(), F.lit(name)) for name, test in rules.items()]
    return df.withColumn("broken", F.filter(F.array(*named), lambda x: x.isNotNull()))


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows by seeded hash of their values: the same rows in every run, however df is partitioned."""
    return df.withColumn("_draw", F.xxhash64(F.lit(seed), *df.columns)).orderBy("_draw", *df.columns).limit(n).drop("_draw")


def partitioned(df: DataFrame, n: int, order: str) -> DataFrame:
    """n contiguous ranges of `order`."""
    return df.repartitionByRange(n, order).sortWithinPartitions(order)


def label_codes(df: DataFrame, column: str, out: str, most: int = 100_000) -> DataFrame:
    """Codes from 0 in the order of the values, for columns of at most `most` values."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    if values.limit(most + 1).count() > most:
        raise ValueError(f"{column} has over {most} values")
    codes = values.withColumn(out, F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_value")) - 1)
    return df.join(F.broadcast(codes), F.col(column) == F.col("_value"), "left").drop("_value")


def resampled(df: DataFrame, time: str, unit: str, group: list[str], value: str) -> DataFrame:
    """Count and mean per period and group."""
    return df.groupBy(F.date_trunc(unit, time).alias("period"), *group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; of equals the least."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def quarantined(df: DataFrame, rules: dict[str, Callable[[], Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and those that do, with the names of the rules in `_error`."""
    marked = where_all(df, rules).withColumnRenamed("broken", "_error")
    return marked.where(F.size("_error") == 0).drop("_error"), marked.where(F.size("_error") > 0)


def temporal_dedup(df: DataFrame, keys: list[str], time: str, seconds: int, tie: str) -> DataFrame:
    """Rows of a key that come at least `seconds` after the key's previous row."""
    w = W.partitionBy(*keys).orderBy(time, tie)
    gap = F.unix_micros(F.col(time)) - F.lag(F.unix_micros(F.col(time))).over(w)
    return df.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= seconds * 1_000_000)).drop("_gap")
