"""Queries over the star-schema tables, one or more per operator, and the same in DuckDB SQL.

The tables are clean, so dirt is derived from keys in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .functions import convert, names, text
from .operators import bi, categories, impute, numbers, rows, rules
from .plans import cleaning, drift, profile
from .sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def holes(c: str, key: str, every: int) -> Column:
    """c, null where the key divides by `every`."""
    return F.when(F.col(key) % every != 0, F.col(c))


def r(c, digits: int = 6) -> Column:
    return F.round(c, digits)


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS_SQL = ", ".join(LINE_KEYS)

# ---- flagship ------------------------------------------------------------


@query(
    "flagship_clean_lineitem",
    """WITH t AS (SELECT DISTINCT * FROM lineitem),
    d AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS q, l_extendedprice AS p,
      greatest(0, least(100, l_discount)) AS disc FROM t),
    b AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.75) AS c FROM d),
    k AS (SELECT d.*, least(greatest(p, a - 1.5 * (c - a)), c + 1.5 * (c - a)) AS cp FROM d, b),
    m AS (SELECT median(q) AS mq FROM k)
    SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(coalesce(q, mq)), 2) AS sum_qty,
      round(sum(cp), 2) AS sum_price, round(avg(disc), 6) AS avg_disc FROM k, m GROUP BY 1, 2""",
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates out, domain clamp, IQR clip, median fill, summary."""
    t = rows.dedup(table(spark, d, "lineitem").select(*LINE_KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    t = t.select("l_returnflag", "l_linestatus", holes("l_quantity", "l_orderkey", 11).alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("discount"))
    # several statistics jobs read the de-duplicated rows: one shuffle instead of one a job
    t = t.withColumn("discount", numbers.clamp_domain("discount")).persist(StorageLevel.MEMORY_AND_DISK)
    t = numbers.treat_outliers(t, numbers.bounds(t, ["p"]), "clip")
    t = impute.numeric_fill(t, ["q"])
    return t.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("q"), 2).alias("sum_qty"), r(F.sum("p"), 2).alias("sum_price"), r(F.avg("discount")).alias("avg_disc")
    )


# ---- profiles and aggregates -----------------------------------------------


@query(
    "profile_nulls",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
      CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders)
    SELECT 'o_orderkey' AS "column", count(*) AS n_rows, count(*) - count(o_orderkey) AS n_nulls FROM t
    UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice) FROM t
    UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus) FROM t""",
)
def profile_nulls(spark, d):
    t = table(spark, d, "orders")
    t = t.select("o_orderkey", holes("o_totalprice", "o_orderkey", 7).alias("o_totalprice"), holes("o_orderstatus", "o_orderkey", 5).alias("o_orderstatus"))
    return profile.null_counts(t)


@query(
    "profile_distinct",
    """SELECT 'user_id' AS "column", count(DISTINCT user_id) AS n_distinct FROM events
    UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events
    UNION ALL SELECT 'props', count(DISTINCT props) FROM events""",
)
def profile_distinct(spark, d):
    return profile.distinct_counts(table(spark, d, "events").select("user_id", "event_type", "props"))


@query(
    "profile_corrupted",
    """SELECT c AS "column", share >= 0.9 OR n <= 1 AS corrupted FROM (
      SELECT 'mostly_null' AS c, avg(CASE WHEN o_orderkey % 20 <> 0 THEN 1.0 ELSE 0.0 END) AS share, count(DISTINCT CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice END) AS n FROM orders
      UNION ALL SELECT 'constant', 0.0, 1
      UNION ALL SELECT 'o_totalprice', 0.0, count(DISTINCT o_totalprice) FROM orders)""",
)
def profile_corrupted(spark, d):
    t = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 20 == 0, F.col("o_totalprice")).alias("mostly_null"), F.lit("x").alias("constant"), "o_totalprice")
    bad = set(profile.corrupted(profile.column_profile(t)))
    return spark.createDataFrame([(c, c in bad) for c in t.columns], "column string, corrupted boolean")


@query(
    "agg_moments",
    """SELECT l_returnflag, round(min(l_extendedprice), 4) AS lo, round(max(l_extendedprice), 4) AS hi, round(avg(l_extendedprice), 4) AS mean,
    round(stddev_samp(l_extendedprice), 4) AS sd, count(*) AS n FROM lineitem GROUP BY 1""",
)
def agg_moments(spark, d):
    c = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.min(c), 4).alias("lo"), r(F.max(c), 4).alias("hi"), r(F.avg(c), 4).alias("mean"), r(F.stddev_samp(c), 4).alias("sd"), F.count(F.lit(1)).alias("n"))


@query(
    "agg_quantiles",
    """SELECT event_type, round(quantile_cont(value, 0.01), 4) AS p01, round(quantile_cont(value, 0.25), 4) AS q1, round(median(value), 4) AS med,
    round(quantile_cont(value, 0.75), 4) AS q3, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1""",
)
def agg_quantiles(spark, d):
    p = lambda q: F.percentile(F.col("value"), F.lit(q))
    return table(spark, d, "events").groupBy("event_type").agg(
        r(p(0.01), 4).alias("p01"), r(p(0.25), 4).alias("q1"), r(F.median("value"), 4).alias("med"), r(p(0.75), 4).alias("q3"), r(p(0.99), 4).alias("p99")
    )


@query(
    "agg_mode",
    """SELECT o_orderstatus, o_orderpriority AS mode FROM (SELECT o_orderstatus, o_orderpriority,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1, 2) WHERE k = 1""",
)
def agg_mode(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.mode("o_orderpriority", True).alias("mode"))


@query("value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, d):
    return categories.value_counts(table(spark, d, "part"), "p_type")


@query("value_freq", "SELECT event_type, round(count(*) / (SELECT count(event_type) FROM events)::DOUBLE, 6) AS share FROM events GROUP BY 1")
def value_freq(spark, d):
    counts = categories.value_counts(table(spark, d, "events"), "event_type")
    total = counts.agg(F.sum("n")).first()[0]
    return counts.select("event_type", r(F.col("n") / F.lit(float(total))).alias("share"))


# ---- de-duplication ----------------------------------------------------------


@query("dedup_full", "SELECT DISTINCT lang, source, text FROM documents")
def dedup_full(spark, d):
    return rows.dedup(table(spark, d, "documents").select("lang", "source", "text"))


@query(
    "dedup_first",
    "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
)
def dedup_first(spark, d):
    return rows.dedup(table(spark, d, "documents").select("doc_id", "text"), ["text"], "first", ["doc_id"])


@query(
    "dedup_last",
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1",
)
def dedup_last(spark, d):
    return rows.dedup(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "last", ["o_orderkey"])


@query("dedup_none", "SELECT doc_id, text FROM documents WHERE text IN (SELECT text FROM documents GROUP BY 1 HAVING count(*) = 1)")
def dedup_none(spark, d):
    return rows.dedup(table(spark, d, "documents").select("doc_id", "text"), ["text"], False)


@query(
    "dedup_hash",
    """SELECT doc_id, lang, h FROM (SELECT doc_id, lang, md5(concat_ws(chr(31), coalesce(lang, ''), coalesce(text, ''))) AS h,
    row_number() OVER (PARTITION BY coalesce(lang, ''), coalesce(text, '') ORDER BY doc_id) AS k FROM documents) WHERE k = 1""",
)
def dedup_hash(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", "text")
    return rows.hash_dedup(t, ["lang", "text"], ["doc_id"]).select("doc_id", "lang", rows.row_hash(["lang", "text"]).alias("h"))


# ---- outliers and ranges -------------------------------------------------------


@query(
    "outlier_iqr_clip",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS p FROM orders),
    b AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.75) AS c FROM t)
    SELECT o_orderkey, round(least(greatest(p, a - 1.5 * (c - a)), c + 1.5 * (c - a)), 4) AS p FROM t, b""",
)
def outlier_iqr_clip(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice")).alias("p"))
    return numbers.treat_outliers(t, numbers.bounds(t, ["p"]), "clip").withColumn("p", r("p", 4))


@query(
    "outlier_zscore_flag",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS p FROM orders),
    b AS (SELECT avg(p) AS m, stddev_samp(p) AS s FROM t)
    SELECT o_orderkey, round(p, 4) AS p, p < m - 3 * s OR p > m + 3 * s AS p_outlier FROM t, b""",
)
def outlier_zscore_flag(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice")).alias("p"))
    return numbers.treat_outliers(t, numbers.bounds(t, ["p"], "zscore"), "flag").withColumn("p", r("p", 4))


@query(
    "outlier_pct_remove",
    """WITH b AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer)
    SELECT c_custkey, c_acctbal FROM customer, b WHERE NOT (c_acctbal < lo OR c_acctbal > hi)""",
)
def outlier_pct_remove(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return numbers.treat_outliers(t, numbers.bounds(t, ["c_acctbal"], "percentile"), "remove")


@query(
    "outlier_replace_median",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 89 = 0 THEN value + 100000 ELSE value END AS v FROM events),
    b AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS c, median(v) AS m FROM t)
    SELECT event_id, round(CASE WHEN v < a - 1.5 * (c - a) OR v > c + 1.5 * (c - a) THEN m ELSE v END, 4) AS v FROM t, b""",
)
def outlier_replace_median(spark, d):
    t = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 89 == 0, F.col("value") + 100000).otherwise(F.col("value")).alias("v"))
    return numbers.treat_outliers(t, numbers.bounds(t, ["v"]), "replace").withColumn("v", r("v", 4))


@query("domain_clamp", "SELECT c_custkey, greatest(c_acctbal, 0) AS salary, least(greatest(c_acctbal / 50, 0), 120) AS user_age, c_acctbal AS average_gross FROM customer")
def domain_clamp(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("salary"), (F.col("c_acctbal") / 50).alias("user_age"), F.col("c_acctbal").alias("average_gross"))
    return t.withColumns({c: numbers.clamp_domain(c) for c in ("salary", "user_age", "average_gross")})


# ---- imputation ------------------------------------------------------------------


@query(
    "impute_median",
    "WITH t AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS value FROM events) SELECT event_id, round(coalesce(value, (SELECT median(value) FROM t)), 6) AS value FROM t",
)
def impute_median(spark, d):
    t = table(spark, d, "events").select("event_id", holes("value", "event_id", 6).alias("value"))
    return impute.numeric_fill(t, ["value"]).withColumn("value", r("value"))


@query(
    "impute_mean",
    "WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS v FROM customer) SELECT c_custkey, round(coalesce(v, (SELECT avg(v) FROM t)), 4) AS v FROM t",
)
def impute_mean(spark, d):
    t = table(spark, d, "customer").select("c_custkey", holes("c_acctbal", "c_custkey", 9).alias("v"))
    return impute.numeric_fill(t, ["v"], "mean").withColumn("v", r("v", 4))


@query(
    "impute_mode",
    """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS s FROM customer),
    m AS (SELECT s FROM t WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1) SELECT c_custkey, coalesce(t.s, m.s) AS s FROM t, m""",
)
def impute_mode(spark, d):
    t = table(spark, d, "customer").select("c_custkey", holes("c_mktsegment", "c_custkey", 4).alias("s"))
    return impute.text_fill(t, ["s"])


@query("impute_constant", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE 'Unknown' END AS s FROM customer")
def impute_constant(spark, d):
    t = table(spark, d, "customer").select("c_custkey", holes("c_mktsegment", "c_custkey", 4).alias("s"))
    return impute.text_fill(t, ["s"], "unknown")


@query("impute_drop", "SELECT event_id, value FROM events WHERE event_id % 6 <> 0")
def impute_drop(spark, d):
    t = table(spark, d, "events").select("event_id", holes("value", "event_id", 6).alias("value"))
    return impute.drop_nulls(t, ["value"])


FILL_SQL = """WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 1 THEN value END AS value FROM events)
    SELECT user_id, event_id, coalesce({0}) AS value FROM t
    WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
BACK, FORTH = "last_value(value IGNORE NULLS) OVER b", "first_value(value IGNORE NULLS) OVER f"


def sparse(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 1, F.col("value")).alias("value"))


@query("ffill_bfill", FILL_SQL.format(f"{BACK}, {FORTH}"))
def ffill_bfill(spark, d):
    return impute.group_fill(sparse(spark, d), "value", ["user_id"], ["event_id"])


@query("bfill_ffill", FILL_SQL.format(f"{FORTH}, {BACK}"))
def bfill_ffill(spark, d):
    return impute.group_fill(sparse(spark, d), "value", ["user_id"], ["event_id"], "bfill")


@query(
    "ordered_fill",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 50 = 1 THEN value END AS value FROM events)
    SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM t""",
)
def ordered_fill(spark, d):
    t = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 == 1, F.col("value")).alias("value"))
    return impute.ordered_fill(t, "value", "event_id", range_rows=1_000)


LINE_SQL = """WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 1 THEN {0} END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(v IGNORE NULLS) OVER b AS pv,
      first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni, first_value(v IGNORE NULLS) OVER f AS nv FROM t
      WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, event_id, {1} FROM k"""


@query("interpolate_linear", LINE_SQL.format("value", "round(coalesce(v, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0)::DOUBLE, pv, nv, 0.0), 6) AS value"))
def interpolate_linear(spark, d):
    return impute.group_interpolate(sparse(spark, d), "value", ["user_id"], ["event_id"]).withColumn("value", r("value"))


@query("interpolate_ts", LINE_SQL.format("epoch_us(ts)", "CAST(floor(coalesce(v, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0)::DOUBLE, pv, nv) / 1000000) AS BIGINT) AS sec"))
def interpolate_ts(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 1, F.col("ts")).alias("ts"))
    return impute.group_interpolate(t, "ts", ["user_id"], ["event_id"]).select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("sec"))


# ---- types and units --------------------------------------------------------------


@query(
    "type_bool",
    """SELECT o_orderkey, CASE WHEN lower(trim(s)) IN ('yes','true','1','y','on','t','si','oui') THEN true WHEN lower(trim(s)) IN ('no','false','0','n','off','f','non') THEN false END AS b
    FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE ' WHEN 3 THEN 'off' ELSE 'maybe' END AS s FROM orders)""",
)
def type_bool(spark, d):
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, " Yes").when(k == 1, "no").when(k == 2, "TRUE ").when(k == 3, "off").otherwise("maybe")
    return table(spark, d, "orders").select("o_orderkey", convert.boolean(s).alias("b"))


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query("type_currency", f"SELECT o_orderkey, round({CENTS} / 100.0, 2) AS price FROM orders")
def type_currency(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    shown = F.concat(F.lit("$ "), F.format_number(cents / 100, 2))
    return table(spark, d, "orders").select("o_orderkey", r(convert.currency(shown), 2).alias("price"))


@query("type_percent", f"SELECT {KEYS_SQL}, round(CAST(round(l_discount * 100) AS BIGINT) / 100.0, 4) AS discount FROM lineitem")
def type_percent(spark, d):
    shown = F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit(" %"))
    return table(spark, d, "lineitem").select(*LINE_KEYS, r(convert.percent(shown), 4).alias("discount"))


@query("type_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 6 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def type_date(spark, d):
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-M-d"]
    k = F.col("o_orderkey") % 7
    shown = F.lit("2025-02-30")
    for i, form in enumerate(forms):
        shown = F.when(k == i, F.date_format("o_orderdate", form)).otherwise(shown)
    return table(spark, d, "orders").select("o_orderkey", convert.timestamp(shown).cast("date").alias("day"))


@query("type_numeric", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN CAST(-p_size AS DOUBLE) END AS v FROM part")
def type_numeric(spark, d):
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    shown = F.when(k == 0, F.concat(F.lit(" "), s, F.lit(".0 "))).when(k == 1, F.concat(F.lit("-"), s)).otherwise(F.concat(s, F.lit("d")))
    return table(spark, d, "part").select("p_partkey", convert.number(shown).alias("v"))


@query("type_unix", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(date_trunc('second', ts) AS TIMESTAMP) AS t FROM events")
def type_unix(spark, d):
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return table(spark, d, "events").select("event_id", sec.alias("sec"), F.timestamp_seconds(sec).cast("timestamp_ntz").alias("t"))


@query(
    "type_gate",
    """WITH t AS (SELECT CASE WHEN o_orderkey % 20 = 0 THEN 'n/k' ELSE '$5' END AS a, CASE WHEN o_orderkey % 5 = 0 THEN 'n/k' ELSE '$5' END AS b FROM orders)
    SELECT 'a' AS c, avg(CASE WHEN a = '$5' THEN 1.0 ELSE 0.0 END) >= 0.9 AS converts FROM t UNION ALL SELECT 'b', avg(CASE WHEN b = '$5' THEN 1.0 ELSE 0.0 END) >= 0.9 FROM t""",
)
def type_gate(spark, d):
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(F.when(k % 20 == 0, "n/k").otherwise("$5").alias("a"), F.when(k % 5 == 0, "n/k").otherwise("$5").alias("b"))
    rates = profile.text_rates(t, ["a", "b"])
    return spark.createDataFrame([(c, rates[c]["currency"]["makes"] >= C.SUCCESS) for c in ("a", "b")], "c string, converts boolean")


@query(
    "units_weight",
    """SELECT p_partkey, round(CASE p_partkey % 5 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 1.0 WHEN 2 THEN p_size * 453.592 WHEN 3 THEN p_size * 28.3495 ELSE p_size * 1.0 END, 4) AS g FROM part""",
)
def units_weight(spark, d):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    shown = F.when(k == 0, F.concat(s, F.lit("kg"))).when(k == 1, F.concat(s, F.lit(" g"))).when(k == 2, F.concat(s, F.lit(" LBs"))).when(k == 3, F.concat(s, F.lit("oz"))).otherwise(s)
    return table(spark, d, "part").select("p_partkey", r(convert.grams(shown), 4).alias("g"))


@query(
    "units_time",
    "SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 0.001 WHEN 1 THEN p_size * 60.0 WHEN 2 THEN p_size * 3600.0 END, 4) AS s FROM part",
)
def units_time(spark, d):
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    shown = F.when(k == 0, F.concat(s, F.lit("ms"))).when(k == 1, F.concat(s, F.lit(" min"))).when(k == 2, F.concat(s, F.lit("hr"))).otherwise(F.lit("soon"))
    return table(spark, d, "part").select("p_partkey", r(convert.seconds(shown), 4).alias("s"))


@query("downcast_ints", f"SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS TINYINT) AS l_linenumber, CAST(l_quantity AS TINYINT) AS l_quantity FROM lineitem")
def downcast_ints(spark, d):
    return numbers.narrow(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_linenumber", "l_quantity"])


# ---- text and categories -------------------------------------------------------------


@query(
    "hidden_nulls",
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE c_mktsegment END AS s FROM customer",
)
def hidden_nulls(spark, d):
    k = F.col("c_custkey") % 5
    s = F.when(k == 0, " N/A ").when(k == 1, "Unknown").when(k == 2, "--").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", text.null_hidden(s).alias("s"))


@query("text_whitespace", "SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS s FROM part")
def text_whitespace(spark, d):
    dirty = F.concat(F.lit("\t "), F.replace(F.col("p_name"), F.lit(" "), F.lit("  ​\n ")), F.lit("­ "))
    return table(spark, d, "part").select("p_partkey", text.plain_space(dirty).alias("s"))


@query("text_upper_code", "SELECT p_partkey, upper(p_brand) AS brand_code FROM part")
def text_upper_code(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper(F.lower("p_brand")).alias("brand_code"))


@query("text_title", "SELECT c_custkey, array_to_string(list_transform(string_split(lower(c_mktsegment || ' of ' || c_mktsegment), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS s FROM customer")
def text_title(spark, d):
    c = F.concat("c_mktsegment", F.lit(" of "), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", text.title(c).alias("s"))


@query(
    "state_expand",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Delhi' WHEN 2 THEN 'Pune Maharashtra' ELSE c_mktsegment END AS s FROM customer",
)
def state_expand(spark, d):
    k = F.col("c_custkey") % 4
    s = F.when(k == 0, "mh").when(k == 1, "DL").when(k == 2, "Pune MH").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", text.expand_state(s).alias("s"))


@query("city_spelling", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Bangalore' WHEN 2 THEN 'Delhi' ELSE 'Springfield' END AS city FROM customer")
def city_spelling(spark, d):
    k = F.col("c_custkey") % 4
    s = F.when(k == 0, "Mumbi").when(k == 1, "Bangalor").when(k == 2, "Delhi").otherwise("Springfield")
    return table(spark, d, "customer").select("c_custkey", text.city(s).alias("city"))


@query("mojibake", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Beyoncé' ELSE c_name END AS s FROM customer")
def mojibake(spark, d):
    s = F.when(F.col("c_custkey") % 2 == 0, F.lit("BeyoncÃ©")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.unicode_repair(s).alias("s"))


@query(
    "category_case",
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN ' ' || lower(p_brand) ELSE p_brand END AS b FROM part),
    n AS (SELECT b, count(*) AS n, lower(trim(b)) AS k FROM t GROUP BY 1),
    best AS (SELECT k, trim(b) AS b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC,
      (trim(b) = upper(trim(b)[1]) || lower(trim(b)[2:])) DESC, b) AS x FROM n) WHERE x = 1)
    SELECT p_partkey, best.b AS b FROM t JOIN best ON lower(trim(t.b)) = best.k""",
)
def category_case(spark, d):
    k = F.col("p_partkey") % 4
    b = F.when(k == 0, F.upper("p_brand")).when(k == 1, F.concat(F.lit(" "), F.lower("p_brand"))).otherwise(F.col("p_brand"))
    return categories.unify_case(table(spark, d, "part").select("p_partkey", b.alias("b")), "b")


@query(
    "category_other",
    """WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), tot AS (SELECT sum(n) AS t, count(*) AS c FROM n)
    SELECT CASE WHEN c > 500 AND n < 0.0006 * t THEN 'Other' ELSE CAST(l_partkey AS VARCHAR) END AS part, CAST(sum(n) AS BIGINT) AS n FROM n, tot GROUP BY 1""",
)
def category_other(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    return categories.value_counts(categories.rare_to_other(t, "part", share=0.0006), "part")


@query("category_fuzzy", "SELECT c_custkey, c_mktsegment AS s FROM customer")
def category_fuzzy(spark, d):
    k = F.col("c_custkey") % 50
    s = F.when(k == 0, F.concat("c_mktsegment", F.lit("x"))).otherwise(F.col("c_mktsegment"))
    return categories.merge_fuzzy(table(spark, d, "customer").select("c_custkey", s.alias("s")), "s")


# ---- rules ---------------------------------------------------------------------------


@query("rule_range", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal <= 5000 THEN c_acctbal END AS v FROM customer")
def rule_range(spark, d):
    return table(spark, d, "customer").select("c_custkey", rules.in_range(F.col("c_acctbal"), 0, 5000).alias("v"))


@query("allowed_values", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS s FROM orders")
def allowed_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rules.in_range(F.col("o_orderstatus"), allowed=["F", "O"]).alias("s"))


@query("rule_email", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN 'u' || c_custkey || '@mail.example' END AS e FROM customer")
def rule_email(spark, d):
    k, n = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    e = F.when(k == 0, F.concat(F.lit(" u"), n, F.lit("@mail.example "))).when(k == 1, F.concat(F.lit("u"), n, F.lit("@mail.example"))).otherwise(F.concat(F.lit("u"), n))
    return table(spark, d, "customer").select("c_custkey", text.email(e).alias("e"))


@query("rule_name_digits", "SELECT c_custkey, CASE WHEN 1 - length(regexp_replace(c_name, '[^0-9]', '', 'g')) / length(c_name)::DOUBLE >= 0.8 THEN c_name END AS full_name FROM customer")
def rule_name_digits(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("full_name"))
    return t.withColumn("full_name", rules.chunk_rule("full_name", t.schema["full_name"].dataType))


@query("phone_normalize", "SELECT c_custkey, '+' || (9000000000 + c_custkey) AS phone FROM customer")
def phone_normalize(spark, d):
    n = (F.lit(9000000000) + F.col("c_custkey")).cast("string")
    shown = F.concat(F.lit("+"), F.substring(n, 1, 5), F.lit(" - ("), F.substring(n, 6, 5), F.lit(") ext"))
    return table(spark, d, "customer").select("c_custkey", text.phone(shown).alias("phone"))


# ---- sets, sorts, dates, scaling ---------------------------------------------------------


@query("union_pad", "SELECT c_custkey AS k, c_name, NULL::DOUBLE AS o_totalprice FROM customer UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def union_pad(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return rows.union_all([a, b])


@query("union_dedup", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def union_dedup(spark, d):
    return rows.union_distinct([table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))])


@query("topk_probe", "SELECT value FROM (SELECT event_id, value FROM events WHERE event_id % 2 = 1 ORDER BY event_id LIMIT 10)")
def topk_probe(spark, d):
    t = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 1, F.col("value")).alias("value"))
    return rows.probe(t, "value", 10, ["event_id"])


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(coalesce(year(x), 0) AS INTEGER) AS x_Year, CAST(coalesce(month(x), 0) AS INTEGER) AS x_Month, CAST(coalesce(day(x), 0) AS INTEGER) AS x_Day,
    CAST(coalesce(quarter(x), 0) AS INTEGER) AS x_Quarter, CAST(coalesce(hour(x), 0) AS INTEGER) AS x_Hour, coalesce(dayname(x), 'Unknown') AS x_WeekDay
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS x FROM orders)""",
)
def date_parts(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", holes("o_orderdate", "o_orderkey", 10).alias("x"))
    return bi.date_parts(t, ["x"]).drop("x")


@query("date_iso", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def date_iso(spark, d):
    return bi.text_dates(table(spark, d, "events").select("event_id", "ts"))


def scaled(spark, d, method: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(*LINE_KEYS, F.col("l_extendedprice").alias("v"))
    return numbers.Scaler(method).fit(t, ["v"]).transform(t)


@query(
    "scale_minmax",
    f"SELECT {KEYS_SQL}, round((l_extendedprice - lo) / (hi - lo), 6) AS v_scaled FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)",
)
def scale_minmax(spark, d):
    return scaled(spark, d, "minmax").select(*LINE_KEYS, r("v_scaled").alias("v_scaled"))


@query(
    "scale_standard",
    f"SELECT {KEYS_SQL}, round((l_extendedprice - m) / s, 5) AS v_scaled FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)",
)
def scale_standard(spark, d):
    return scaled(spark, d, "standard").select(*LINE_KEYS, r("v_scaled", 5).alias("v_scaled"))


@query(
    "scale_robust",
    f"""SELECT {KEYS_SQL}, round((l_extendedprice - m) / (c - a), 6) AS v_scaled FROM lineitem,
    (SELECT median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem)""",
)
def scale_robust(spark, d):
    return scaled(spark, d, "robust").select(*LINE_KEYS, r("v_scaled").alias("v_scaled"))


@query("scale_inverse", f"SELECT {KEYS_SQL}, round(l_extendedprice, 2) AS v FROM lineitem")
def scale_inverse(spark, d):
    t = table(spark, d, "lineitem").select(*LINE_KEYS, F.col("l_extendedprice").alias("v"))
    s = numbers.Scaler("standard").fit(t, ["v"])
    return s.inverse(s.transform(t)).select(*LINE_KEYS, r("v", 2).alias("v"))


# ---- BI, drift, scan ------------------------------------------------------------------------


@query(
    "bi_roles",
    "SELECT * FROM (VALUES ('o_orderkey', 'dimension'), ('o_totalprice', 'measure'), ('o_orderdate', 'date'), ('o_orderpriority', 'dimension')) t(c, role)",
)
def bi_roles(spark, d):
    found = bi.roles(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"))
    return spark.createDataFrame(list(found.items()), "c string, role string")


@query("bi_drop_useless", "SELECT o_orderkey, o_totalprice FROM orders")
def bi_drop_useless(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"))
    return t.drop(*bi.useless(t))


@query("bi_drop_blobs", "SELECT doc_id, lang, source FROM documents")
def bi_drop_blobs(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", "source", "text", F.md5("text").alias("digest"))
    return t.drop(*bi.blobs(t))


@query(
    "power_bi_keys",
    "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_totalprice FROM orders",
)
def power_bi_keys(spark, d):
    return bi.keys_formatted(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))


@query("tableau_ready", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, 0.0) AS v, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, 'Unknown') AS s FROM customer")
def tableau_ready(spark, d):
    t = table(spark, d, "customer").select("c_custkey", holes("c_acctbal", "c_custkey", 3).alias("v"), holes("c_mktsegment", "c_custkey", 5).alias("s"))
    return bi.aggregation_ready(t).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("bi_recommend", "SELECT * FROM (VALUES ('Line', 'High'), ('Bar', 'High'), ('Pie', 'Medium'), ('KPI', 'Low')) t(chart, priority)")
def bi_recommend(spark, d):
    found = bi.recommend(table(spark, d, "orders").select("o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"))
    return spark.createDataFrame([(x["chart"], x["priority"]) for x in found], "chart string, priority string")


@query("calc_fields", "SELECT 'Total Value' AS name, '[l_quantity] * [l_extendedprice]' AS formula")
def calc_fields(spark, d):
    found = bi.calculated_fields(table(spark, d, "lineitem").columns)
    return spark.createDataFrame([(x["name"], x["formula"]) for x in found], "name string, formula string")


@query(
    "scan_report",
    """SELECT n_rows, (SELECT count(*) FROM (DESCRIBE orders)) AS n_columns, round(share, 6) AS duplicate_share,
    CASE WHEN share >= 0.10 THEN 'High' WHEN share >= 0.02 THEN 'Medium' ELSE 'Low' END AS duplicate_risk, 'Mixed' AS complexity
    FROM (SELECT count(*) AS n_rows, 1 - count(DISTINCT (o_custkey, o_orderstatus, o_orderpriority)) / count(*) AS share FROM orders)""",
)
def scan_report(spark, d):
    t = table(spark, d, "orders")
    share = profile.duplicate_share(t.select("o_custkey", "o_orderstatus", "o_orderpriority"))
    kind = "n_rows long, n_columns long, duplicate_share double, duplicate_risk string, complexity string"
    return spark.createDataFrame([(t.count(), len(t.columns), round(share, 6), profile.risk(share), profile.complexity(t))], kind)


@query("schema_drift", "SELECT * FROM (VALUES ('renamed', 'o_totalprice', 'o_totalprices'), ('new', 'country', ''), ('changed', 'o_custkey', 'HIGH')) t(kind, c, detail)")
def schema_drift(spark, d):
    t = table(spark, d, "orders")
    old = drift.snapshot(t)["columns"]
    new = drift.snapshot(t.withColumnRenamed("o_totalprice", "o_totalprices").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("country", F.lit("x")))["columns"]
    found = drift.compare(old, new)
    out = [("renamed", a, b) for a, b in found["renamed_columns"].items()] + [("new", c, "") for c in found["new_columns"]]
    out += [("changed", c, x["risk"]) for c, x in found["changed_types"].items()]
    return spark.createDataFrame(out, "kind string, c string, detail string")


@query("recommend_engine", "SELECT * FROM (VALUES ('Pandas', 1), ('Polars', 1), ('Dask', 8), ('Spark', 16)) t(engine, partitions)")
def recommend_engine(spark, d):
    cases = [(0.05, 50_000), (0.5, 1_200_000), (25, 10_000_000), (150, 100_000_000)]
    return spark.createDataFrame([(readers.recommend_engine(g, n), readers.recommend_partitions(g)) for g, n in cases], "engine string, partitions int")


@query("name_rules", "SELECT * FROM (VALUES ('customer_name'), ('revenue'), ('city'), ('age'), ('col'), ('sales'), ('sales_1')) t(c)")
def name_rules(spark, d):
    got = names.normalised(["Customer Name", "Revenue($)", "CITY", "__age__", "", "sales", "sales"])
    return spark.createDataFrame([(c,) for c in got], "c string")


# ---- further operations ----------------------------------------------------------------------------


@query("orphan_check", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 0)")
def orphan_check(spark, d):
    parents = table(spark, d, "customer").where(F.col("c_custkey") % 10 != 0)
    return rows.orphans(table(spark, d, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey")


@query("pii_mask", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'write to [EMAIL] now' ELSE c_name END AS s FROM customer")
def pii_mask(spark, d):
    s = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("write to u"), F.col("c_custkey").cast("string"), F.lit("@mail.example now"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.mask(s, "email").alias("s"))


@query("json_expand", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_expand(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    "html_strip",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM pages""",
)
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("s"))


@query(
    "sessionize",
    """SELECT event_id, user_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
    SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS n FROM events)""",
)
def sessionize(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.sessions(t, "user_id", "ts", 1800, "event_id").select("event_id", "user_id", "session")


@query(
    "rolling_median",
    "SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m FROM events",
)
def rolling_median(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", "value")
    return rows.rolling_median(t, ["user_id"], ["event_id"], "value", 4, "m").select("event_id", r("m").alias("m"))


@query(
    "cross_rules",
    f"SELECT {KEYS_SQL}, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'few' END, CASE WHEN l_tax > l_discount THEN 'tax' END) AS broken FROM lineitem",
)
def cross_rules(spark, d):
    t = table(spark, d, "lineitem").select(*LINE_KEYS, "l_quantity", "l_tax", "l_discount")
    out = rows.where_all(t, {"few": lambda: F.col("l_quantity") <= 45, "tax": lambda: F.col("l_tax") <= F.col("l_discount")})
    return out.select(*LINE_KEYS, F.concat_ws(",", "broken").alias("broken"))


@query("label_codes", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def label_codes(spark, d):
    return rows.label_codes(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("resample_days", "SELECT CAST(date_trunc('day', ts) AS DATE) AS period, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def resample_days(spark, d):
    out = rows.resampled(table(spark, d, "events"), "ts", "day", ["event_type"], "value")
    return out.select(F.col("period").cast("date").alias("period"), "event_type", "n", r("mean").alias("mean"))


@query("top_values", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def top_values(spark, d):
    return rows.top_values(table(spark, d, "part"), "p_brand", 5)


@query(
    "temporal_dedup",
    """SELECT event_id FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
    WHERE g IS NULL OR g >= 3600000000""",
)
def temporal_dedup(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.temporal_dedup(t, ["user_id"], "ts", 3600, "event_id").select("event_id")


@query("quarantine", "SELECT c_custkey, 'negative' AS error FROM customer WHERE c_acctbal < 0")
def quarantine(spark, d):
    _, bad = rows.quarantined(table(spark, d, "customer").select("c_custkey", "c_acctbal"), {"negative": lambda: F.col("c_acctbal") >= 0})
    return bad.select("c_custkey", F.array_join("_error", ",").alias("error"))


@query("value_patterns", "SELECT regexp_replace(regexp_replace(c_name, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g') AS shape, count(*) AS n FROM customer GROUP BY 1")
def value_patterns(spark, d):
    return profile.value_patterns(table(spark, d, "customer"), "c_name")


@query("emoji_and_base64", "SELECT c_custkey, 'hi ' || c_name AS a, c_name AS b FROM customer")
def emoji_and_base64(spark, d):
    plain = F.concat(F.lit("hi "), F.col("c_name"))
    dirty = F.concat(plain, F.lit("\U0001f600\u2764\ufe0f"))
    coded = F.base64(F.col("c_name").cast("binary"))
    return table(spark, d, "customer").select("c_custkey", text.strip_emoji(dirty).alias("a"), text.decoded_base64(coded).alias("b"))


@query("pii_rates", "SELECT * FROM (VALUES ('mail', 'email', 0.5)) t(c, kind, share)")
def pii_rates(spark, d):
    mail = F.when(F.col("o_orderkey") % 2 == 0, F.lit("a@b.org")).otherwise(F.lit("none"))
    t = table(spark, d, "orders").select(mail.alias("mail"))
    return spark.createDataFrame([(c, k, round(v, 1)) for c, x in profile.pii_rates(t).items() for k, v in x.items()], "c string, kind string, share double")


def _written(spark: SparkSession, name: str) -> str:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lapidary-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = _written(spark, "round") + ".csv"
    writers.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return readers.load(spark, path)


@query("json_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_round_trip(spark, d):
    path = _written(spark, "round") + ".json"
    writers.write_json(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return readers.load(spark, path)


@query("parquet_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def parquet_round_trip(spark, d):
    path = _written(spark, "round") + ".parquet"
    writers.write_parquet(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return readers.load(spark, path)


@query("inferred_types", "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS done FROM orders")
def inferred_types(spark, d):
    """Typed columns from text alone."""
    t = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("No").alias("done"),
    )
    out = cleaning.fit_types(t, cleaning.Config(), cleaning.Plan())
    return out.withColumns({"day": F.col("day").cast("date")})


@query(
    "auto_clean_customers",
    """WITH t AS (SELECT c_custkey, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS b FROM customer),
    q AS (SELECT quantile_cont(b, 0.25) AS a, quantile_cont(b, 0.75) AS c FROM t),
    k AS (SELECT c_custkey, c_mktsegment, CASE WHEN b IS NOT NULL THEN least(greatest(b, a - 1.5 * (c - a)), c + 1.5 * (c - a)) END AS b FROM t, q)
    SELECT CAST(c_custkey AS VARCHAR) AS cust_id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment_name,
      round(coalesce(b, (SELECT median(b) FROM k)), 2) AS balance FROM k""",
)
def auto_clean_customers(spark, d):
    """The whole plan: types, text, duplicates, outliers, rules, nulls, categories, audit."""
    t = table(spark, d, "customer")
    seg = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lit("  "), "c_mktsegment"))
    dirty = t.select(F.col("c_custkey").cast("string").alias("cust_id"), seg.alias("segment_name"), holes("c_acctbal", "c_custkey", 7).alias("balance"), F.col("c_custkey").alias("_row_id"))
    got, _ = cleaning.clean(dirty.unionByName(dirty.limit(5)))
    return got.select("cust_id", "segment_name", r(F.col("balance").cast("double"), 2).alias("balance"))
