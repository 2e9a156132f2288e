"""Exact quantiles without a table-sized hash map.

A sketch brackets each order statistic that a quantile needs; one more pass counts what
lies below each bracket and, within it, counts distinct values, which are few. A bracket that
still holds too many values is bracketed again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most distinct values of one bracket that reach the driver.
MOST = 20_000
ACCURACY = 10_000


def quantiles(df: DataFrame, wanted: dict[str, list[float]], most: int = MOST) -> dict[str, list[float | None]]:
    """For each column its quantiles at the shares asked for, linearly interpolated; None for a column of nulls.

    Two jobs for all columns: a sketch, then counts; more only for brackets of over `most` distinct values.
    """
    if not wanted:
        return {}
    name = {c: f"q{i}" for i, c in enumerate(wanted)}
    slim = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in name.items()])
    aggs = []
    for c, n in name.items():
        step = 2.0 / ACCURACY
        shares = sorted({min(1.0, max(0.0, p + s)) for p in wanted[c] for s in (-step, step)})
        aggs += [F.count(n).alias(f"{n}n"), F.min(n).alias(f"{n}lo"), F.max(n).alias(f"{n}hi")]
        aggs.append(F.percentile_approx(n, F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias(f"{n}a"))
        name[c] = n
    got = slim.agg(*aggs).first()
    targets: list[tuple[str, int, float, float]] = []  # column, rank from 0, bracket
    for c, n in name.items():
        count = got[f"{n}n"]
        if not count:
            continue
        cuts = [got[f"{n}lo"], *got[f"{n}a"], got[f"{n}hi"]]
        step = 2.0 / ACCURACY
        shares = [0.0, *sorted({min(1.0, max(0.0, p + s)) for p in wanted[c] for s in (-step, step)}), 1.0]
        for p in wanted[c]:
            low = max((x for s, x in zip(shares, cuts, strict=True) if s <= p - step or s == 0.0), default=cuts[0])
            high = min((x for s, x in zip(shares, cuts, strict=True) if s >= p + step or s == 1.0), default=cuts[-1])
            for k in {math.floor((count - 1) * p), math.ceil((count - 1) * p)}:
                targets.append((n, k, low, high))
    values = _ranks(slim, targets, most)
    out: dict[str, list[float | None]] = {}
    for c, n in name.items():
        count = got[f"{n}n"]
        out[c] = []
        for p in wanted[c]:
            if not count:
                out[c].append(None)
                continue
            at = (count - 1) * p
            a, b = values[(n, math.floor(at))], values[(n, math.ceil(at))]
            out[c].append(a + (b - a) * (at - math.floor(at)))
    return out


def _ranks(slim: DataFrame, targets: list[tuple[str, int, float, float]], most: int) -> dict[tuple[str, int], float]:
    brackets = sorted({(n, a, b) for n, _, a, b in targets})
    if not brackets:
        return {}
    inside = [(F.col(n) >= F.lit(a)) & (F.col(n) <= F.lit(b)) for n, a, b in brackets]
    counts = slim.agg(
        *[F.count_if(F.col(n) < F.lit(a)).alias(f"b{i}") for i, (n, a, _) in enumerate(brackets)],
        *[F.count_if(x).alias(f"i{i}") for i, x in enumerate(inside)],
    ).first()
    hits = F.array(*[F.when(x, F.struct(F.lit(i).alias("i"), F.col(n).alias("v"))) for i, (x, (n, _, _)) in enumerate(zip(inside, brackets, strict=True))])
    found = slim.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).groupBy("h.i", "h.v").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.i: r.d for r in found.groupBy("i").agg(F.count(F.lit(1)).alias("d")).collect()} if any(counts[f"i{i}"] > most for i in range(len(brackets))) else {}
    small = [i for i in range(len(brackets)) if sizes.get(i, 0) <= most]
    table: dict[int, list] = {}
    for r in found.where(F.col("i").isin(small)).collect() if small else []:
        table.setdefault(r.i, []).append((r.v, r.n))
    out, again = {}, []
    for n, k, a, b in targets:
        i = brackets.index((n, a, b))
        below, within = counts[f"b{i}"], counts[f"i{i}"]
        if not below <= k < below + within:  # the sketch erred: look in all that is left
            again.append((n, k, float("-inf") if k < below else b, a if k < below else float("inf")))
        elif i in table:
            at = below
            for v, m in sorted(table[i]):
                at += m
                if k < at:
                    out[(n, k)] = v
                    break
        else:
            cut = slim.where(inside[i]).agg(F.percentile_approx(n, F.array(*[F.lit(x / 64) for x in range(65)]), F.lit(ACCURACY))).first()[0]
            rank = (k - below) / max(1, within)
            j = min(63, int(rank * 64))
            again.append((n, k, cut[max(0, j - 1)], cut[min(64, j + 2)]))
    return out | (_ranks(slim, again, most) if again else {})
