"""Category operators: one spelling per category, rare values as Other."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text

#: Most rows for which a lookup table is broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 100_000


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Values that are not null, with n."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def apply_map(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """column replaced by table(value -> new) where it has the value."""
    table = table.select(F.col("value").alias("_value"), F.col("new").alias("_new"))
    hint = F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table
    joined = df.join(hint, F.col(column) == F.col("_value"), "left")
    return joined.withColumn(column, F.coalesce("_new", F.col(column))).drop("_value", "_new")


def case_map(df: DataFrame, column: str) -> DataFrame:
    """value -> new: of spellings equal but for case and outer space the most frequent, of equals the title form, then the least."""
    counts = value_counts(df, column).withColumn("_low", F.lower(F.trim(column)))
    plain = F.trim(column)
    is_title = (plain == F.initcap(plain)).cast("int")
    w = W.partitionBy("_low").orderBy(F.desc("n"), F.desc(is_title), F.col(column))
    best = counts.withColumn("new", F.first(F.trim(column)).over(w))
    return best.select(F.col(column).alias("value"), "new").where("value != new")


def unify_case(df: DataFrame, column: str) -> DataFrame:
    return apply_map(df, column, case_map(df, column))


def fuzzy_map(df: DataFrame, column: str, cutoff: float = C.FUZZY, most: int = C.FUZZY_GROUPS) -> dict[str, str]:
    """Rare value -> most similar more frequent one of `cutoff` or more, one hop; {} for over `most` values.

    At most `most` + 1 values reach the driver. Of equal scores the greatest value wins.
    """
    top = value_counts(df, column).orderBy(F.desc("n"), F.desc(F.length(column)), column).limit(most + 1).collect()
    if len(top) > most:
        return {}
    order, out = [r[column] for r in top], {}
    for i, v in enumerate(order):
        found = difflib.get_close_matches(v.lower(), [u.lower() for u in order[:i]], n=1, cutoff=cutoff)
        if found:
            out[v] = next(u for u in order[:i] if u.lower() == found[0])
    return out


def merge_fuzzy(df: DataFrame, column: str, cutoff: float = C.FUZZY, most: int = C.FUZZY_GROUPS) -> DataFrame:
    table = fuzzy_map(df, column, cutoff, most)
    if not table:
        return df
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return df.withColumn(column, F.coalesce(F.try_element_at(lookup, F.col(column)), F.col(column)))


def standardise(df: DataFrame, column: str, fuzzy: bool = False, cutoff: float = C.FUZZY) -> DataFrame:
    """One spelling per case, then (fuzzy) per near spelling, then title form where the name asks for it."""
    df = unify_case(df, column)
    if fuzzy:
        df = merge_fuzzy(df, column, cutoff)
    low = column.lower()
    if any(w in low for w in ("city", "state", "country", "name", "location", "address")) and "email" not in low:
        df = df.withColumn(column, text.title(F.col(column)))
    return df


def rare_to_other(df: DataFrame, column: str, many: int = C.MANY_VALUES, share: float = C.RARE_SHARE, other: str = "Other") -> DataFrame:
    """With over `many` distinct values, those of a share under `share` of the non-null rows become `other`.

    At most 1 / share values are kept, so the lookup is bounded whatever the table's size.
    """
    counts = value_counts(df, column)
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total or distinct <= many:
        return df
    kept = F.broadcast(counts.where(F.col("n") >= share * total).select(F.col(column).alias("_kept")))
    joined = df.join(kept, F.col(column) == F.col("_kept"), "left")
    new = F.when(F.col(column).isNull(), None).when(F.col("_kept").isNull(), F.lit(other)).otherwise(F.col(column))
    return joined.withColumn(column, new).drop("_kept")
