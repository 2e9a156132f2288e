"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of the mix are cut into blocks of equal size. Sources get blocks by
the highest quotients target / (2k + 1); each source's quota is apportioned to
its shards (seeded hash pieces of its documents) the same way; within a shard,
whose documents stand in seeded order, the first blocks up to the quota are
taken, going round again if the quota asks for more words than there are.

No step lists blocks: the seats that are certain are computed, and only the at
most two disputed seats per party are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def sainte_lague(parties: DataFrame, seats: Column, weight: str, within: list[str], order: list[str], out: str) -> DataFrame:
    """parties with `out`: the seats each gets of its group's `seats` by the highest quotients.

    within: columns of the groups (may be empty). Ties go to the earlier party
    by `order`. Parties of no weight get none.
    """
    keys = [F.col(c) for c in within] or [F.lit(0)]
    group = W.partitionBy(*keys)
    n = F.count(F.lit(1)).over(group)
    total = F.sum(weight).over(group)
    low = F.greatest(F.lit(0.0), seats - n / 2.0)  # with this many seats' divisor rounding gives out at most `seats`
    high = seats + n / 2.0
    seat = lambda many: F.floor(F.when(total > 0, F.col(weight) * many / total).otherwise(0.0) + 0.5)
    floor = F.when(seats - n / 2.0 > 0, seat(low)).otherwise(F.lit(0)).cast("long")
    p = parties.withColumns({"_seats": seats, "_sure": floor, "_most": seat(high).cast("long") + 1})
    p = p.withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    disputed = (
        p.where(F.col(weight) > 0)
        .withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.greatest(F.col("_most"), F.col("_sure")))))
        .withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over(group.orderBy(F.col("_q").desc(), *order, "_k")))
        .where(F.col("_rank") <= F.col("_open"))
        .groupBy(*(within + [o for o in order if o not in within]))
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    on = within + [o for o in order if o not in within]
    return (
        p.join(disputed, on, "left")
        .withColumn(out, F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0)))
        .drop("_seats", "_sure", "_most", "_open", "_won")
    )


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources(skey, source_size) with rank and target.

    Sources by code point, null last, weigh `weights` in turn and share `share`
    times all words; no target passes `most` times its source's size, and the
    excess goes to the others by weight. Closed form: sort by cap / weight; those before the
    first source whose cap holds the common level are full.
    """
    line = W.partitionBy(F.lit(0)).orderBy("skey")
    wave = W.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "skey")
    everyone = W.partitionBy(F.lit(0))
    s = sources.withColumn("rank", F.row_number().over(line))
    s = s.withColumns(
        {
            "_w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")),
            "_cap": F.col("source_size") * float(most),
            "_all": F.sum("source_size").over(everyone) * float(share),
        }
    )
    before = wave.rowsBetween(W.unboundedPreceding, -1)
    since = wave.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(since))
    held = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("skey"), F.col("_level").alias("level")))).over(everyone)
    s = s.withColumn("_level", F.coalesce(held["level"], F.lit(float("inf"))))
    return s.withColumn("target", F.least(F.col("_cap"), F.col("_level") * F.col("_w"))).drop("_w", "_cap", "_all", "_level")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block_words: int | None = None,
    shard_rows: int = 2_000,
    seed: int = 7,
) -> DataFrame:
    """Every row of df, in the struct `row`, with size, source_size, target, taken, copies and part.

    taken words of a row = copies * size + part: whole repeats, then the first
    or last `part` words (`part_from` words are skipped before). block_words:
    words per block; by default 1 to 2048, at most a 1024th of the least positive target and
    a 128th of a source's words per shard, as a shard may miss less than one block of its quota.

    Null ids and sources are ordinary values (the null source comes last); null
    and empty texts have size 0 and are taken 0 times. Rows with equal ids keep
    apart; rows equal in id and size may swap places. A source without words
    has target 0. An empty table gives no rows. Reruns agree.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    skey = F.when(F.col(f"row.`{source}`").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(f"row.`{source}`").cast("string")))
    sized = df.select(row.alias("row")).select("row", skey.alias("skey"), common.word_count(F.col(f"row.`{text}`")).alias("size"))
    draw = F.xxhash64(F.lit(seed), F.col(f"row.`{id_col}`"), F.col("size"))
    drawn = common.stage(sized.select("skey", "size", draw.alias("_draw")), "mix-sizes")
    totals = common.stage(
        drawn.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")), "mix-sources"
    )
    planned = targets(totals, weights, share, most)
    held = F.col("source_size") / F.ceil(F.col("_docs") / shard_rows)
    some = lambda c: F.min(F.when(F.col("target") > 0, c))
    least, narrow, whole = planned.agg(some(F.col("target")), some(held), F.sum("target")).first()
    block = block_words or max(1, min(2048, int((least or 0) // 1024), int((narrow or 0) // 128)))
    seats = F.lit(int((whole or 0) // block))
    sources = sainte_lague(planned, seats, "target", [], ["skey"], "_blocks")
    sources = sources.withColumns(
        {
            "_blocks": F.least(F.col("_blocks"), F.floor(F.col("source_size") * most / block).cast("long")),
            "_pieces": F.ceil(F.col("_docs") / shard_rows).cast("int"),
        }
    ).select("skey", "source_size", "target", "_blocks", "_pieces")
    sources = common.small(common.stage(sources, "mix-quotas"))
    piece = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_draw")), F.col("_pieces")).cast("int")
    placed = sized.join(sources, "skey").withColumn("_draw", draw).withColumn("_piece", piece)
    pieces = drawn.join(sources, "skey").withColumn("_piece", piece).groupBy("skey", "_piece").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks"))
    quotas = sainte_lague(pieces, F.col("_blocks"), "_words", ["skey"], ["_piece"], "_quota")
    quotas = quotas.withColumn("_quota", F.least(F.col("_quota"), F.floor(F.col("_words") * most / block).cast("long")))
    quotas = common.small(common.stage(quotas.select("skey", "_piece", "_words", "_quota"), "mix-shards"))
    inside = W.partitionBy("skey", "_piece").orderBy("_draw", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = placed.withColumn("_end", F.sum("size").over(inside)).join(quotas, ["skey", "_piece"])
    got = F.col("_quota") * block
    rounds = F.when(F.col("_words") > 0, F.floor(got / F.col("_words"))).otherwise(0).cast("long")
    rest = got - rounds * F.col("_words")
    part = F.greatest(F.lit(0), F.least(F.col("_end"), rest) - (F.col("_end") - F.col("size"))).cast("long")
    out = ordered.select("row", "skey", "size", "source_size", "target", rounds.alias("_rounds"), part.alias("_part"))
    whole_part = (F.col("_part") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        "row",
        "size",
        "source_size",
        "target",
        (F.col("_rounds") * F.col("size") + F.col("_part")).alias("taken"),
        (F.when(F.col("size") > 0, F.col("_rounds")).otherwise(0) + whole_part.cast("long")).alias("copies"),
        F.when(whole_part, 0).otherwise(F.col("_part")).cast("long").alias("part"),
    )


def mixed_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row's columns once per whole copy, and once more with the first
    `part` words of its text (white space before and between them kept) where a block ends inside it."""
    body = F.col(f"row.`{text}`")
    # cut after each word, so that the pieces keep the white space before their word
    pieces = F.split(body, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")
    names = [f.name for f in mixed.schema["row"].dataType.fields]
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int")))
    takes = F.concat(F.coalesce(times, F.array().cast("array<int>")), F.when(F.col("part") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    rows = mixed.select("row", "part", F.explode(takes).alias("_take"))
    return rows.select(*[F.when(F.col("_take") == 0, cut).otherwise(body).alias(n) if n == text else F.col(f"row.`{n}`").alias(n) for n in names])
