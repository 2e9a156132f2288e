"""Sharding: a two-pass external shuffle.

Pass one scatters records into memory-sized buckets by seeded hashes; pass two
shuffles each bucket (Fisher-Yates, the engine's `shuffle` of an array) and
writes it below its shard's folder.

A record's shard is the one whose seeded hash with the key is highest
(rendezvous hashing), so the key and the number of shards alone decide, and
one shard more takes records only into itself. Within a shard, sub-buckets of
about `bucket_bytes` bound what a task holds; their number follows the bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rank(key: Column, shard: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), key, shard).alias("h"), shard.alias("s"))


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """struct(h, s): the winning shard s and its hash h."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: _rank(key, s, seed)))


def write_shards(
    df: DataFrame,
    path: str,
    shards: int = 24,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = 16 << 20,
    seed: int = 20,
) -> DataFrame:
    """Write all rows of df under path/shard=N/ in shuffled order; returns the written
    rows: every column of df in the struct `row`, and bucket, pos, shard, grown_shard.

    Rows keep (bucket, pos), their place: buckets in order, rows by pos within
    one. Reruns over the same rows with the same `shards`, `seed` and
    `bucket_bytes` agree, as a bucket's rows are put in hash order first.

    Null keys hash like one more key; null texts weigh nothing but are kept.
    Equal keys share a shard (the law), yet rows that differ in any column are
    spread over its sub-buckets. Rows equal in every column share a sub-bucket.
    An empty table writes nothing and returns no rows. Other columns, whatever
    their names, travel inside `row`.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long") + 8)).first()[0] or 0
    parts = max(1, -(-total // (shards * bucket_bytes)))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    won = shard_of(F.col(f"row.`{key}`"), shards, seed)
    mark = F.xxhash64(F.lit(seed + 1), F.col("row"))
    scattered = (
        df.select(row.alias("row"))
        .select("row", won.alias("won"), mark.alias("mark"))
        .select(
            (F.col("won.s") * parts + F.pmod(F.col("mark"), F.lit(parts))).cast("int").alias("bucket"),
            F.struct(F.col("mark"), F.col("won.h").alias("h"), F.col("row")).alias("item"),
        )
    )
    bucketed = (
        scattered.repartitionById(shards * parts, F.col("bucket"))  # a task for each bucket, so its shuffle has its own seed
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    written = (
        bucketed.select("bucket", F.posexplode(F.shuffle("items", F.lit(seed))).alias("pos", "item"))
        .select("bucket", F.col("pos").cast("long").alias("pos"), "item.row", F.col("item.h").alias("h"))
        .select(
            "row",
            "bucket",
            "pos",
            F.when(F.xxhash64(F.lit(seed), F.col(f"row.`{key}`"), F.lit(shards)) > F.col("h"), F.lit(shards))
            .otherwise((F.col("bucket") / parts).cast("int"))
            .cast("int")
            .alias("grown_shard"),
            F.floor(F.col("bucket") / parts).cast("int").alias("shard"),
        )
    )
    written.write.partitionBy("shard").parquet(path)
    return spark.read.schema(written.schema).parquet(path)


def slots(written: DataFrame, *keep: Column) -> DataFrame:
    """keep, shard, grown_shard and the gapless slot of each written row within its shard."""
    spark = written.sparkSession
    counts = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts.createOrReplaceTempView("lapidary_shard_counts")
    offsets = spark.sql(
        "SELECT bucket, sum(n) OVER (PARTITION BY shard ORDER BY bucket) - n AS first FROM lapidary_shard_counts"
    )
    spark.catalog.dropTempView("lapidary_shard_counts")
    rows = written.select(*keep, "shard", "grown_shard", "bucket", "pos")
    return rows.join(offsets, "bucket").withColumn("slot", F.col("first") + F.col("pos")).drop("first", "bucket", "pos")
