"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is the set of its paragraphs' digests: 48 bits of hash and 16 bits of
check. A sketch spreads the digests over buckets of 24 cells; a digest is
XORed into one cell of each third of its bucket. Cell by cell, two sketches
subtract (XOR); what is common vanishes, and peeling recovers the rest: a cell
that holds one digest passes the check, the digest leaves its other cells,
and so on. If that gets stuck, a larger sketch is tried.

Everything is array functions inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

CELLS, LOAD = 24, 4
#: Paragraphs end at newlines and sentence ends, those of scripts without spaces included.
BREAK = r"\n|(?<=[.!?…]) |(?<=[。！？｡．।۔؟])"
#: Where a paragraph of over LONG code points has no sentence end its words place the breaks: at clause ends, and between some pairs of letters.
LONG, FINE = 300, r"(?<=[,;:]) |(?<=[、，；：])|(?<=[aeioumn]) (?=[abist])"
#: The same breaks for a replacement by newlines: the sign is matched instead of looked back for at every place, which takes a fraction of the time.
BREAK_AFTER = r"([.!?…]) |([。！？｡．।۔؟])"
FINE_AFTER = r"([,;:]) |([、，；：])|([aeioumn]) (?=[abist])"


def digests(text: Column) -> Column:
    """The set of a text's paragraph digests; paragraphs without a word do not count."""

    def digest(p: Column) -> Column:
        high = lambda h: h.bitwiseAND(F.lit(-65536))
        return common.let(high(F.xxhash64(p)), lambda h: h.bitwiseOR(F.xxhash64(h).bitwiseAND(F.lit(65535))))

    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), BREAK_AFTER, "$1$2\n"), "\n")
    fine = lambda p: F.split(F.regexp_replace(p, FINE_AFTER, "$1$2$3\n"), "\n")
    parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > LONG, fine(p)).otherwise(F.array(p))))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p.rlike(r"[^\x20\x09-\x0D]")), digest))


def _bucket(d: Column, buckets: Column, salt: int | Column) -> Column:
    return F.pmod(F.xxhash64(d, F.lit(salt)), buckets).cast("int")


def _places(d: Column, salt: int | Column) -> list[Column]:
    """The three cells of a digest within its bucket, one in each third, counted from the third's start."""
    h = F.xxhash64(d, F.lit(salt + 1))
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(7)).cast("int") for k in (0, 20, 40)]


def _mask(d: Column, salt: int | Column) -> Column:
    """Bits of the three cells of a digest within its bucket."""
    bits = [F.call_function("shiftleft", F.lit(1 << (8 * t)), p) for t, p in enumerate(_places(d, salt))]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _has(mask: Column, cell: Column) -> Column:
    return F.call_function("shiftright", mask, cell).bitwiseAND(F.lit(1)) == 1


def _xor(ds: Column, start: Column) -> Column:
    return F.aggregate(ds, start, lambda a, x: a.bitwiseXOR(x))


def sketch(ds: Column, buckets: Column, salt: int | Column = 0) -> Column:
    """CELLS cells per bucket, one array. A digest that ds has twice cancels out: the
    sketch of two sets one after the other is the difference of their sketches."""
    zero, eight = F.lit(0).cast("long"), F.array(*[F.lit(c) for c in range(CELLS // 3)])
    third = [f"p{t}" for t in range(3)]

    def item(d: Column) -> Column:
        return F.struct(_bucket(d, buckets, salt).alias("b"), d.alias("d"), *[p.alias(n) for n, p in zip(third, _places(d, salt), strict=True)])

    def into(own: Column, place: str, c: Column) -> Column:
        return F.aggregate(own, zero, lambda a, x: F.when(x[place] == c, a.bitwiseXOR(x["d"])).otherwise(a))

    def cells(own: Column) -> Column:
        filled = lambda n: F.transform(eight, lambda c: into(own, n, c))
        return F.concat(*map(filled, third))

    def few(own: Column) -> Column:  # most cells stay empty
        def filled(n: str) -> Column:
            return common.let(
                F.transform(own, lambda x: x[n]),
                lambda at: F.transform(eight, lambda c: F.when(F.array_contains(at, c), into(own, n, c)).otherwise(zero)),
            )

        return F.concat(*map(filled, third))

    def spread(items: Column, start: Column, end: Column, shifts: tuple[int, ...]) -> Column:
        # runs of buckets, then runs of those, then each: no look at all digests for every bucket
        if not shifts:
            return F.flatten(F.transform(F.sequence(start, end), lambda b: common.let(F.filter(items, lambda x: x["b"] == b), few)))
        shift = F.lit(shifts[0])
        up = lambda x: F.call_function("shiftright", x, shift)

        def run(k: Column) -> Column:
            a = F.call_function("shiftleft", k, shift)
            z = F.least(a + F.lit((1 << shifts[0]) - 1), end)
            return common.let(F.filter(items, lambda x: up(x["b"]) == k), lambda own: spread(own, a, z, shifts[1:]))

        return F.flatten(F.transform(F.sequence(up(start), up(end)), run))

    one = common.let(F.transform(ds, item), cells)
    many = common.let(F.transform(ds, item), lambda items: spread(items, F.lit(0), buckets - 1, (10, 5, 3)))
    return F.when(buckets == 1, one).otherwise(many)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def _peel_buckets(cells: Column, buckets: Column, salt: int | Column, rounds: int = 10) -> Column:
    """For each bucket the digests in a difference of sketches, or null if some cell stays filled."""
    whole = lambda x: F.xxhash64(x.bitwiseAND(F.lit(-65536))).bitwiseAND(F.lit(65535)) == x.bitwiseAND(F.lit(65535))

    def rounds_of(own: Column, b: Column) -> Column:
        def single(x: Column, c: Column) -> Column:
            return (x != 0) & whole(x) & (_bucket(x, buckets, salt) == b) & _has(_mask(x, salt), c)

        def step(s: Column, _: Column) -> Column:
            pure = F.transform(F.array_distinct(F.filter(s["cells"], single)), lambda d: F.struct(d.alias("d"), _mask(d, salt).alias("m")))

            def without(p: Column) -> Column:
                clear = lambda x, c: F.aggregate(p, x, lambda a, y: F.when(_has(y["m"], c), a.bitwiseXOR(y["d"])).otherwise(a))
                found = F.concat(s["found"], F.transform(p, lambda y: y["d"]))
                return F.struct(F.transform(s["cells"], clear).alias("cells"), found.alias("found"), (F.size(p) > 0).alias("open"))

            return F.when(s["open"], common.let(pure, without)).otherwise(s)

        start = F.struct(own.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(True).alias("open"))
        done = lambda s: F.when(~F.exists(s["cells"], lambda x: x != 0), s["found"])
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, done)

    def one_bucket(own: Column, b: Column) -> Column:
        """One round mostly finds all: each third's cells add up to all digests of the bucket, so the sum
        less those found is zero or, like a cell, the one that is left. If the cells of those found are
        not just the filled ones, or more are left, the rounds begin."""
        filled = F.array_remove(own, F.lit(0).cast("long"))

        def rest(pure: Column) -> Column:
            left = _xor(pure, _xor(F.slice(own, 1, CELLS // 3), F.lit(0).cast("long")))
            return common.let(left, lambda x: F.when(x == 0, pure).when(whole(x), F.concat(pure, F.array(x))))

        def checked(found: Column) -> Column:
            covered = F.aggregate(found, F.lit(0), lambda a, x: a.bitwiseOR(_mask(x, salt)))
            return F.when(F.bit_count(covered) == F.size(filled), found)

        def peeled(pure: Column) -> Column:
            return F.when(F.size(pure) > 0, F.coalesce(common.let(rest(pure), checked), rounds_of(own, b)))

        pure = F.filter(F.array_distinct(filled), lambda x: whole(x) & (_bucket(x, buckets, salt) == b))
        return F.when(F.size(filled) == 0, F.array().cast("array<bigint>")).otherwise(common.let(pure, peeled))

    each = lambda b: common.let(F.slice(cells, b * CELLS + 1, F.lit(CELLS)), lambda own: one_bucket(own, b))
    return F.transform(F.sequence(F.lit(0), buckets - 1), each)


def peel(cells: Column, buckets: Column, salt: int = 0, rounds: int = 10) -> Column:
    """The digests in a difference of sketches, or null if some cell stays filled."""
    # flatten gives null if any bucket is null
    return F.flatten(_peel_buckets(cells, buckets, salt, rounds))


def difference(a: Column, b: Column, base_a: Column, base_b: Column, tries: int = 3) -> Column:
    """The digests of which a or b has one and the other none.

    First from the two base sketches of one bucket, then, on failure, from
    larger ones fit for both sets; the buckets that get stuck there are sketched
    again, with twice the cells for a digest and salted anew at each try. If all
    fail (under one in a million), or if what was peeled is in neither set, by
    comparing the sets themselves.
    """
    one = F.lit(1)
    first = common.let(subtract(base_a, base_b), lambda cells: peel(cells, one))

    none = F.array().cast("array<bigint>")

    def attempt(s: Column, by: Column) -> Column:
        many = F.greatest(F.ceil(F.size(s["rest"]) * by["more"] / LOAD).cast("int"), one)

        def again(n: Column, got: Column) -> Column:
            stuck = F.filter(s["rest"], lambda d: got[_bucket(d, n, by["salt"])].isNull())
            found = F.flatten(F.filter(got, lambda x: x.isNotNull()))
            return F.struct(F.concat(s["found"], found).alias("found"), F.when(F.exists(got, lambda x: x.isNull()), stuck).otherwise(none).alias("rest"))

        def by_buckets(n: Column) -> Column:
            peeled = common.let(sketch(s["rest"], n, by["salt"]), lambda cells: _peel_buckets(cells, n, by["salt"]))
            return common.let(peeled, lambda got: again(n, got))

        return F.when(F.size(s["rest"]) > 0, common.let(many, by_buckets)).otherwise(s)

    start = F.struct(none.alias("found"), F.concat(a, b).alias("rest"))
    each = F.array(*[F.struct(F.lit(10 * (k + 1)).alias("salt"), F.lit(2**k).alias("more")) for k in range(tries)])
    larger = F.aggregate(each, start, attempt, lambda s: F.when(F.size(s["rest"]) == 0, s["found"]))
    exact = F.concat(F.array_except(a, b), F.array_except(b, a))
    known = lambda found: F.when(F.size(F.array_except(F.array_except(found, a), b)) == 0, found)
    return F.coalesce(common.let(first, known), common.let(larger, known), exact)


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Jaccard likeness of two digest sets from their sizes and difference; 1 for two empty sets."""
    both, d = F.size(a) + F.size(b), F.size(differing)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))


def serialize(ds: Column, base: Column) -> Column:
    """The fingerprint as text: the number of paragraphs and the base cells in hexadecimal."""
    return F.concat(F.lit("iblt24:"), F.size(ds).cast("string"), F.lit(":"), F.array_join(F.transform(base, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprint(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """df with {prefix}digests, {prefix}base (the sketch of one bucket) and {prefix}fingerprint.

    Null and empty texts have no digests and the sketch of zeros.
    """
    df = df.withColumn(f"{prefix}digests", digests(F.col(text)))
    df = df.withColumn(f"{prefix}base", sketch(F.col(f"{prefix}digests"), F.lit(1)))
    return df.withColumn(f"{prefix}fingerprint", serialize(F.col(f"{prefix}digests"), F.col(f"{prefix}base")))


def with_next(
    df: DataFrame, id_col: str, columns: list[str], bucket_rows: int = 4_000, most_buckets: int = 4_096, ties: list[str] | None = None
) -> DataFrame:
    """df with next_<c> for each of columns: those of the next row by descending id, after the last the first's.

    Ids are cut into ranges of about `bucket_rows` by percentiles; each range is
    ordered by itself, with the first rows of the range below as its end. Ties
    of id are ordered by the hash of the columns (or of `ties`); null ids come last. Rows of
    one id share a range, so ids should be nearly unique.
    """
    key = F.col(id_col)
    count = df.select(id_col).count()
    if not count:
        return df.withColumns({f"next_{c}": F.col(c) for c in columns})
    many = max(1, min(most_buckets, count // bucket_rows))
    cuts = []
    if many > 1:
        shares = [i / many for i in range(1, many)]
        cuts = df.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * many)))).first()[0] or []
        cuts = sorted(set(cuts))
    width = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if rows:  # two looks of the root's length each: which run of cuts, and how far into it
        typed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
        run = F.greatest(F.size(F.filter(typed([r[0] for r in rows]), lambda x: x < key)) - 1, F.lit(0))
        inside = F.size(F.filter(F.array(*map(typed, rows))[F.col("_run")], lambda x: x < key))
        placed = df.withColumn("_run", run).withColumn("_bucket", F.when(key.isNull(), -1).otherwise(F.col("_run") * width + inside)).drop("_run")
    else:
        placed = df.withColumn("_bucket", F.when(key.isNull(), -1).otherwise(0))
    tops = sorted((r[0], r[1]) for r in placed.groupBy("_bucket").agg(F.max(key)).collect())
    above = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    known = [t for t in above if t is not None]
    is_top = F.coalesce(key.isin(known), F.lit(False)) if known else F.lit(False)
    to = F.create_map(*[F.lit(x) for t in known for x in (t, above[t])]) if known else None
    ghost = F.lit(above.get(None, 0)).cast("int")
    if to is not None:
        ghost = F.when(key.isNull(), ghost).otherwise(F.try_element_at(to, key).cast("int"))
    own = F.struct(F.col("_bucket").cast("int").alias("b"), F.lit(0).alias("g"))
    twice = F.array(own, F.struct(ghost.alias("b"), F.lit(1).alias("g")))
    placed = placed.withColumn("_at", F.explode(F.when(is_top | (key.isNull() & F.lit(None in above)), twice).otherwise(F.array(own))))
    order = W.partitionBy("_at.b").orderBy(F.col("_at.g"), key.desc_nulls_last(), F.xxhash64(*(ties or columns)))
    led = placed.withColumn("_next", F.lead(F.struct(*columns)).over(order)).where(F.col("_at.g") == 0)
    return led.withColumns({f"next_{c}": F.col("_next")[c] for c in columns}).drop("_next", "_at", "_bucket")


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
