"""Jaccard join of documents on word shingles by chosen paths.

Documents with equal shingle sets are one class from the start. Classes are
split recursively on sampled shared shingles: a class joins the bucket of each
shingle that a seeded hash of (path, shingle) chooses, and buckets that are
still large split again on further shingles, for as many levels as that takes,
so that two similar sets meet in a small bucket with constant chance; the number
of independent runs makes that chance reach the target recall. Buckets of more
sets than a task should hold split by distributed passes; all others split
further inside their task. Small buckets are brute-forced on samples of the
sets; buckets of nearly equal sets, which no shingle can split, are joined to
zones, of which all pairs of samples are compared, block by block.

What is found similar by sample only says which classes to look at together:
their groups are then compared exactly, all pairs, block by block, on the whole
sets. Pairs never leave a block; degrees and spanning links do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_WORDS: dict[bytes, int] = {}
_LONGS = lambda *names: T.StructType([T.StructField(c, T.LongType()) for c in names])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of `width` words; a shorter text is one run."""
    if len(_WORDS) > 300_000:
        _WORDS.clear()
    words = text.encode("utf-8", "surrogatepass").split()  # bytes part at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    try:
        codes = [_WORDS[w] for w in words]
    except KeyError:
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        codes = [_WORDS[w] for w in words]
    h = np.array(codes, np.uint64)
    m = max(1, len(h) - width + 1)
    out = np.zeros(m, np.uint64)
    for k in range(min(width, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    return np.unique(_mix(out + np.uint64(min(width, len(h)))))


def uid_of(id_col: str, text: str) -> Column:
    """The id of a row, or, where it is null, one from its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(F.xxhash64(F.col(text)), 1))


def _emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; after the last the worker's word hashes go, so that later stages find its memory free."""
    yield from batches
    _WORDS.clear()


def sketches(df: DataFrame, id_col: str, text: str, width: int, keep: int) -> DataFrame:
    """id, uid, n (shingles), k1, k2 (equal for equal sets) and sample (four bytes of each of the `keep` least hashes) of each row."""
    common.ship(df.sparkSession)
    schema = _LONGS("id", "uid", "n", "k1", "k2").add("sample", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _emptied(batches):
            ids, uids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i, uid in enumerate(uids):
                t = batch.column(2)[i].as_py()
                if t is None:
                    rows.append((ids[i], uid, -1, uid, 0, b""))
                    continue
                s = shingles(t, width)
                if len(s):
                    k1, k2 = _mix(s + np.uint64(1)).sum(), np.bitwise_xor.reduce(_mix(s ^ np.uint64(0x5851F42D4C957F2D)))
                else:  # texts without words are equal only to themselves
                    k1, k2 = np.uint64(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))), np.uint64(0)
                rows.append((ids[i], uid, len(s), int(k1.astype(np.int64)), int(k2.astype(np.int64)), s[:keep].astype("<u4").tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return df.select(F.col(id_col).cast("long").alias("id"), uid_of(id_col, text).alias("uid"), F.col(text).alias("text")).mapInArrow(run, schema)


#: Children of a set at each level but the first; and how often the second level is gone through anew.
LATER, AGAIN = 1.7, 3
#: Share of common hashes in the samples of sets that look similar, and the mean share in buckets too alike to split.
LOOKS, DENSE = 0.55, 0.55


def meeting(overlap: float, children: float) -> float:
    """A bound below the chance that one run brings two sets, whose samples share `overlap` of the hashes, into one
    small bucket, however deep it lies. At each later level a set has LATER children, and LATER * overlap is over 1 for
    all but rare samples, so the chance has a bound that no depth goes below; the second level is gone through AGAIN times."""
    deep = 1.0
    for _ in range(2000):
        deep = 1 - math.exp(-overlap * LATER * deep)
    return 1 - math.exp(-overlap * children * (1 - (1 - deep) ** AGAIN))


def runs_for(recall: float, threshold: float, children: float, keep: int) -> int:
    """Runs after which a pair at the threshold has met with chance `recall`, at any depth.

    Of a set and a subset of it at the threshold the share `threshold` of the sample is common, which varies as a
    sample of `keep` does; any other pair has more. The chance is the mean over that spread."""
    law = [(math.comb(keep, k) * threshold**k * (1 - threshold) ** (keep - k), meeting(k / keep, children)) for k in range(keep + 1)]
    runs = 1
    while sum(p * (1 - m) ** runs for p, m in law if p > 1e-12) > 1 - recall:
        runs += 1
    return runs


def _flat(samples: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of the samples, one after the other, and the number of each sample's."""
    return np.frombuffer(b"".join(samples), "<u4").astype(np.uint64), np.array([len(s) // 4 for s in samples], np.int64)


def chosen(paths: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, children: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of each shingle that the hash of (path, shingle) chooses; row r has paths[r] and the next sizes[r] tokens."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    h = _mix(paths[row] + (tokens + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    hit = np.flatnonzero((h >> np.uint64(34)) < (float(1 << 30) * children / np.maximum(sizes, 1))[row])
    return row[hit], _mix(h[hit] ^ np.uint64(0x2545F4914F6CDD1D))


def _children(df: DataFrame, starts: list[int], children: float) -> DataFrame:
    """(path, uid) of the children of the rows (uid, sample) or (path, uid, sample) of df, from each of the seeds `starts`."""
    common.ship(df.sparkSession)
    schema, rooted = _LONGS("path", "uid"), "path" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            tokens, sizes = _flat(batch.column("sample").to_pylist())
            own = batch.column("path").to_numpy().view(np.uint64) if rooted else np.zeros(len(uid), np.uint64)
            for start in starts:
                row, path = chosen(_mix(own + np.uint64(start)), tokens, sizes, children)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(uid[row])], schema.names)

    return df.select(*(["path"] if rooted else []), "uid", "sample").mapInArrow(run, schema)


def by_key(df: DataFrame, key: list[str], body: Callable[[tuple, list], list[tuple]], schema: T.StructType) -> DataFrame:
    """body(key, columns) for each key's rows, which are gathered one key at a time from sorted partitions.

    Columns of longs come as arrays, others as lists; the keys are the first columns, and longs."""
    common.ship(df.sparkSession)
    assert df.columns[: len(key)] == key
    long = [t == "bigint" for _, t in df.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema.names)

        def whole(parts: list[list]) -> list:
            if len(parts) == 1:
                return parts[0]
            return [np.concatenate(c) if is_long else [x for part in c for x in part] for is_long, c in zip(long, zip(*parts, strict=True), strict=True)]

        held: list[list] = []
        last, out = None, []
        for batch in _emptied(batches):
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() if is_long else c.to_pylist() for is_long, c in zip(long, batch.columns, strict=True)]
            keys = np.stack(columns[: len(key)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(keys[:, a].tolist())
                if held and now != last:
                    out += body(last, whole(held))
                    held = []
                last = now
                held.append([c[a:b] for c in columns])
            if len(out) > 50_000:
                yield made(out)
                out = []
        if held:
            out += body(last, whole(held))
        yield made(out)

    return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _spanning(near: np.ndarray, names: list[int]) -> list[tuple[int, int]]:
    """Links (least name of its component, name) over a symmetric boolean matrix."""
    out, left = [], set(range(len(names)))
    for i in sorted(left, key=lambda i: names[i]):
        if i not in left:
            continue
        left.discard(i)
        wave = [i]
        while wave:
            reach = np.flatnonzero(near[wave].any(axis=0)).tolist()
            wave = [j for j in reach if j in left]
            left.difference_update(wave)
            out += [(names[i], names[j]) for j in wave]
    return out


def _overlaps(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """The sizes of all pairwise intersections."""
    k = len(sets)
    if k == 2:
        both = float(len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    tokens, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    column = np.full(len(tokens), -1)
    shared = count > 1
    column[shared] = np.arange(shared.sum())
    at = column[inverse]
    row, at = row[at >= 0], at[at >= 0]
    out = np.zeros((k, k), np.float64)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for start in range(0, int(shared.sum()), chunk):
        a, b = np.searchsorted(at, [start, start + chunk])
        m = np.zeros((k, chunk), np.float32)
        m[row[a:b], at[a:b] - start] = 1
        out += m @ m.T
    return out


def _looks(uid: np.ndarray, n: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Spanning links of the sets that look similar by their samples."""
    kept = np.array([len(s) for s in sets])
    near = _overlaps(sets) >= LOOKS * np.minimum.outer(kept, kept)
    near &= np.minimum.outer(n, n) >= threshold * np.maximum.outer(n, n) - 1e-9
    return _spanning(near, uid.tolist())


def _alike(tokens: np.ndarray, at: np.ndarray, sizes: np.ndarray, rows: np.ndarray, path: int, probes: int = 24) -> bool:
    """Whether the sets of `rows` share DENSE of their samples and more, on the mean of pairs that a hash of the path picks."""
    picks = _mix(np.arange(2 * probes, dtype=np.uint64) + np.uint64(path)) % np.uint64(len(rows))
    shares = []
    for a, b in rows[picks.astype(np.int64)].reshape(-1, 2):
        if a != b:
            x, y = tokens[at[a] : at[a] + sizes[a]], tokens[at[b] : at[b] + sizes[b]]
            shares.append(len(np.intersect1d(x, y)) / max(1, min(sizes[a], sizes[b])))
    return bool(shares) and sum(shares) >= DENSE * len(shares)


def inside(path: int, uid: np.ndarray, n: np.ndarray, samples: list[bytes], threshold: float, bucket: int, most_levels: int = 64) -> list[tuple[int, int, int]]:
    """(a, b, 0): links of sets that look similar; (a, b, 1): stars over buckets that no shingle splits.

    The sets of one bucket split further, in this task, until buckets hold `bucket` sets at most. What has
    not split after `most_levels` levels counts as unsplittable, so nothing is left uncompared."""
    if len(uid) < 2:
        return []
    tokens, sizes = _flat(samples)
    at = np.cumsum(sizes) - sizes
    out: list[tuple[int, int, int]] = []
    waiting = [(path & (2**64 - 1), np.arange(len(uid)), 0)]
    while waiting:
        path, rows, level = waiting.pop()
        if len(rows) <= bucket:
            sets = [tokens[at[r] : at[r] + sizes[r]] for r in rows.tolist()]
            out += [(a, b, 0) for a, b in _looks(uid[rows], n[rows], sets, threshold)]
            continue
        if level == most_levels or _alike(tokens, at, sizes, rows, path):
            least = int(uid[rows].min())
            out += [(least, u, 1) for u in uid[rows].tolist() if u != least]
            continue
        many = sizes[rows]
        own = tokens[np.repeat(at[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        for again in range(1 if level else AGAIN):
            row, child = chosen(_mix(np.full(len(rows), path, np.uint64) + np.uint64(again + 1)), own, many, LATER)
            order = np.argsort(child, kind="stable")
            row, child = row[order], child[order]
            cuts = [0, *(np.flatnonzero(child[1:] != child[:-1]) + 1).tolist(), len(child)]
            waiting += [(int(child[a]), rows[row[a:b]], level + 1) for a, b in zip(cuts, cuts[1:], strict=False) if b > a + 1]
    return out


def _dense(members: DataFrame) -> DataFrame:
    """path, a (the least uid) and dense of the buckets of members (path, uid, sample), told by eight members that a hash picks."""
    picks = [F.min_by("sample", F.xxhash64("uid", F.lit(k))).alias(f"s{k}") for k in range(8)]
    probe = members.groupBy("path").agg(F.min("uid").alias("a"), *picks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                tokens, sizes = _flat(list(row))
                sets = [x for x in np.split(tokens, np.cumsum(sizes)[:-1]) if len(x)]
                pairs = [(x, y) for i, x in enumerate(sets) for y in sets[:i]]
                shares = [len(np.intersect1d(x, y)) / min(len(x), len(y)) for x, y in pairs]
                told.append(sum(shares) >= DENSE * len(shares))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(told, pa.bool_())], ["path", "a", "dense"])

    return probe.mapInArrow(run, _LONGS("path", "a").add("dense", T.BooleanType()))


def _split(rows: DataFrame, reps: DataFrame, held: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Of rows (path, uid): those of buckets of 2 to `held` sets, links (a, b, 1) over larger buckets that
    no shingle can split (None: there are none), and the number of levels gone through."""
    final = stars = None
    level = 0
    while True:
        level += 1
        sizes = common.stage(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        small = rows.join(sizes.where(F.col("size") <= held).select("path"), "path", "left_semi")
        final = small if final is None else final.unionByName(small)
        large = sizes.where(F.col("size") > held).select("path")
        if not large.limit(1).count():
            break
        members = common.stage(rows.join(common.small(large), "path").join(reps.select("uid", "sample"), "uid"), "members")
        told = members.join(common.small(common.stage(_dense(members), "probes")), "path")
        star = told.where("dense AND a != uid").select("a", F.col("uid").alias("b"), F.lit(1).cast("long").alias("star")).distinct()
        stars = star if stars is None else stars.unionByName(star)
        rows = common.stage(_children(told.where("NOT dense"), list(range(1, 1 + (AGAIN if level == 1 else 1))), LATER), "paths")
    return final, None if stars is None else common.stage(stars, "stars"), level


def _placed(groups: DataFrame, block: int, weight: str | None = None, most: int = 400_000) -> DataFrame:
    """groups (uid, label) with blocks, the number of blocks of the label, and i, the row's own.

    A block has about `block` rows, and about `most` of the column `weight` if there are several."""
    many = F.ceil(F.count(F.lit(1)) / block)
    if weight:
        many = F.greatest(many, F.least(F.count(F.lit(1)), F.ceil(F.sum(weight) / most)))
    sizes = groups.groupBy("label").agg(many.cast("int").alias("blocks"))
    return groups.join(sizes, "label").withColumn("i", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("long"))


def _in_pairs(placed: DataFrame, *columns: str) -> DataFrame:
    """Each row once for each pair (x, y) of its label's blocks that its own is in."""
    other = F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)
    return placed.withColumn("o", F.explode(other)).select("label", F.least("i", "o").alias("x"), F.greatest("i", "o").alias("y"), "i", *columns)


def candidate_links(reps: DataFrame, threshold: float, recall: float, keep: int, bucket: int, held: int, block: int, children: float, seed: int) -> DataFrame:
    """Spanning links (a, b) of classes (uid, n, sample) that look similar by their samples."""
    runs = runs_for(recall, threshold, children, keep)
    starts = [int(x) for x in _mix(np.arange(runs, dtype=np.uint64) + np.uint64(seed * 1_000_003)) >> np.uint64(1)]
    rows = common.stage(_children(reps, starts, children), "paths")
    final, stars, _ = _split(rows, reps, held)
    meet = final.join(reps.select("uid", "n", "sample"), "uid").select("path", "uid", "n", "sample")
    links = by_key(meet, ["path"], lambda k, c: inside(k[0], c[1], c[2], c[3], threshold, bucket), _LONGS("a", "b", "star"))
    if stars is not None:
        links = links.unionByName(stars)
    found = common.stage(links.where("a != b").distinct(), "looks")
    stars, found = found.where("star = 1").select("a", "b"), found.where("star = 0").select("a", "b")
    if stars.limit(1).count():
        # what no shingle splits: overlapping dense buckets are one zone, of which all pairs are compared, block by block
        zones = _placed(components(stars), block).join(reps.select("uid", "n", "sample"), "uid")

        def pairs(k: tuple, columns: list) -> list[tuple]:
            tokens, sizes = _flat(columns[6])
            return _looks(columns[4], columns[5], np.split(tokens, np.cumsum(sizes)[:-1]), threshold)

        found = found.unionByName(by_key(_in_pairs(zones, "uid", "n", "sample"), ["label", "x", "y"], pairs, _LONGS("a", "b")))
        found = common.stage(found.distinct(), "candidates")
    return found


def components(links: DataFrame) -> DataFrame:
    """(uid, label): the least uid of each link component, for all uids in links (a, b).

    Each round every node moves to its first neighbour and the links follow
    their ends, until none is left between different nodes. In even rounds the
    first is the least, which contracts stars at once; in odd rounds ranks are
    dealt anew by a seeded hash, of which each leaves a constant share of the nodes
    on average, whatever the shape of the links, so that rounds grow with the
    logarithm of the nodes. Rounds are written out, so none depends on the
    lineage of the one before.
    """
    pairs = links.select("a", "b").where("a != b")
    nodes = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    label = nodes.select("uid", F.col("uid").alias("label"))
    turn = 0
    while True:
        rank = (lambda c, t=turn: F.xxhash64(F.lit(t), c)) if turn % 2 else (lambda c: c)
        both = pairs.union(pairs.select("b", "a"))
        first = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("rank"), F.col("b").alias("p"))).alias("f"))
        parent = common.stage(first.select("a", F.when(F.col("f.rank") < rank(F.col("a")), F.col("f.p")).otherwise(F.col("a")).alias("p")), "parents")
        label = label.join(parent, F.col("label") == F.col("a"), "left").select("uid", F.coalesce("p", "label").alias("label"))
        left, right = parent.select("a", F.col("p").alias("x")), parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        ends = pairs.join(left, "a").join(right, "b").where("x != y")
        pairs = common.stage(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        turn += 1
        if turn % 8 == 0:
            label = common.stage(label, "labels")
        if not pairs.limit(1).count():
            break
    label = common.stage(label, "labels")
    least = label.groupBy("label").agg(F.min("uid").alias("least"))
    return common.stage(label.join(least, "label").select("uid", F.col("least").alias("label")), "labels")


def join(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    keep: int = 64,
    bucket: int = 128,
    held: int = 16_384,
    block: int = 256,
    children: float = 1.25,
    seed: int = 3,
) -> DataFrame:
    """One row per row of df: id, class_id, n_links and set_id.

    Two documents are linked if their sets of `width`-word shingles have a
    Jaccard similarity of `threshold` or more (at least 0.8 here). class_id: the least id of
    all that links reach; set_id: the least id with the same set; n_links: the
    number of documents linked to this one, copies included.

    A text of fewer words is one shingle. Texts without words are linked only
    to equal texts, null texts to none. Rows with equal ids count as one document;
    null ids get one from their text. An empty table gives no rows.

    bucket: sets compared all with all; held: sets of a bucket that split on inside one task; block: sets of a
    block in comparisons of whole groups. They bound a task's memory and cap nothing.
    """
    rows = common.stage(sketches(df, id_col, text, width, keep), "sketches")
    key = ["n", "k1", "k2"]
    classes = rows.groupBy(*key).agg(F.min("uid").alias("uid"), F.count_distinct("uid").alias("size"), F.min_by("sample", "uid").alias("sample"))
    reps = common.stage(classes, "classes")
    links = candidate_links(reps.where("n > 0").select("uid", "n", "sample"), threshold, recall, keep, bucket, held, 2 * block, children, seed)
    placed = _placed(components(links).join(reps.select("uid", "size", "n"), "uid"), block, "n")
    texts = df.select(uid_of(id_col, text).alias("uid"), F.col(text).alias("text")).where("text IS NOT NULL")
    # rows with equal ids: the first text that has the class's least id stands for it
    full = placed.join(texts, "uid").groupBy("uid").agg(*[F.first(c).alias(c) for c in ("label", "blocks", "i", "size")], F.min("text").alias("text"))
    # each text becomes its set once, whatever the number of blocks that it is compared with
    schema = _LONGS("uid", "label", "blocks", "i", "size").add("whole", T.BinaryType())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _emptied(batches):
            made = pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column(5)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], made], schema.names)

    full = full.select("uid", "label", F.col("blocks").cast("long").alias("blocks"), "i", "size", "text").mapInArrow(sets, schema)
    spread = _in_pairs(full, "uid", "size", "whole")

    def exact(k: tuple, columns: list) -> list[tuple]:
        part, uid, weight = columns[3:6]
        if len(uid) < 2:
            return []
        sets = [np.frombuffer(x, np.uint64) for x in columns[6]]
        n = np.array([len(s) for s in sets], np.float64)
        inter = _overlaps(sets)
        near = 5 * inter >= 4 * (np.add.outer(n, n) - inter) if threshold == 0.8 else inter >= threshold * (np.add.outer(n, n) - inter)
        np.fill_diagonal(near, False)
        if k[1] != k[2]:  # pairs of one block are another task's
            near &= part[:, None] != part[None, :]
        out = [(u, -1, d, 0) for u, d in zip(uid.tolist(), (near @ weight).tolist(), strict=True) if d]
        return out + [(a, b, 0, 1) for a, b in _spanning(near, uid.tolist())]

    found = common.stage(by_key(spread, ["label", "x", "y"], exact, _LONGS("a", "b", "degree", "link")), "found")
    label = components(found.where("link = 1").select("a", "b"))
    degrees = found.where("link = 0").groupBy(F.col("a").alias("uid")).agg(F.sum("degree").alias("degree"))
    told = reps.select(*key, F.col("uid").alias("set_id"), "size").join(label.withColumnRenamed("uid", "set_id"), "set_id", "left")
    told = told.join(degrees.withColumnRenamed("uid", "set_id"), "set_id", "left")
    told = common.stage(
        told.select(
            *key,
            "set_id",
            F.coalesce("label", "set_id").alias("class_id"),
            (F.col("size") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"),
        ),
        "classified",
    )
    return rows.select("id", "uid", *key).join(told, key).select(F.col("id").alias(id_col), "uid", "class_id", "n_links", "set_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", **joining) -> DataFrame:
    """The rows of df that stay if of each group of linked documents the one of the least id stays.

    Of rows equal in id and text one stays. Columns and texts are unchanged.
    """
    uid, turn = common.fresh("_uid", df.columns), common.fresh("_turn", df.columns)
    found = join(df, id_col, text, **joining)
    kept = found.where("uid = class_id").select(F.col("uid").alias(uid)).distinct()
    rows = df.withColumn(uid, uid_of(id_col, text)).join(kept, uid, "left_semi")
    again = F.row_number().over(W.partitionBy(uid, F.xxhash64(F.col(text))).orderBy(uid))
    return rows.withColumn(turn, again).where(F.col(turn) == 1).drop(uid, turn)
