"""Quality rules: text statistics and learned decision lists.

A list is learned by sequential covering: each rule grows, one threshold at a
time, the conjunction that gains most information on the grow part of the
labelled rows, is pruned on the rest, and takes what it covers away; learning
stops when a rule no longer earns its place. The list is emitted as one
ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
FEATURES = ["n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share"]


def _windows(words: Column) -> Column:
    """The hashes of the three-word windows, in order; empty for under four words."""
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(words) >= 4, common.let(words, hashes)).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(windows: Column, few: int = 24) -> Column:
    """Words in windows that occur twice or more, the first occurrence included.

    Three ways with one result: no two windows equal; few distinct repeated
    ones, looked up among all; else windows sorted with their places, so that
    equal ones stand side by side.
    """

    def repeated(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (s[F.greatest(i - 1, F.lit(0))] == x)))

    def sought(d: Column) -> Column:
        places = F.transform(windows, lambda x, i: F.when(F.array_contains(d, x), i))
        return F.filter(places, lambda i: i.isNotNull())

    def sorted_out(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda i, j: s[i]["h"] == s[j]["h"]
        hit = lambda x, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < last) & same(F.least(i + 1, last), i))
        return F.sort_array(F.transform(F.filter(s, hit), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = lambda x, i: F.when(i < F.size(p) - 1, F.least(F.lit(3), p[F.least(i + 1, F.size(p) - 1)] - x)).otherwise(3)
        return F.aggregate(F.transform(p, step), F.lit(0), lambda a, x: a + x)

    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    some = lambda d: common.let(F.when(F.size(d) <= few, sought(d)).otherwise(common.let(placed, sorted_out)), covered)
    found = common.let(common.let(F.sort_array(windows), repeated), some)
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), 0).otherwise(found).cast("long")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns in the struct `row`, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null texts count as empty: all zero. Other columns travel inside `row`,
    whatever their names. Texts are read whole; a row's arrays are bounded by its text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = common.let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v)))
    # words and windows are read by several expressions, so the optimizer keeps them columns of their own
    rows = df.select(row.alias("row")).withColumn("words", common.word_list(F.col(f"row.`{text}`")))
    rows = rows.select("row", F.size("words").cast("long").alias("n_words"), _windows(F.col("words")).alias("windows"))
    found = F.struct(
        "n_words",
        (F.length(body) - F.regexp_count(body, F.lit(common.SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("windows")).alias("n_repeat_words"),
    )
    # a condition on statistics would be pushed below and compute them again for each of its mentions; not through a generator
    return rows.select("row", F.explode(F.array(found)).alias("found")).select("row", "found.*")


def base_failed() -> Column:
    """Too short, or more than half repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold); covered rows are rejected."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, cut in self.tests:
            out = out & (values[name] <= F.lit(cut) if sign == "<=" else values[name] > F.lit(cut))
        return out

    def covers(self, row: dict[str, float]) -> bool:
        return all(row[f] <= c if s == "<=" else row[f] > c for f, s, c in self.tests)


def _counts(tests, rows) -> tuple[int, int]:
    rule = Rule(tuple(tests))
    hit = [bad for x, bad in rows if rule.covers(x)]
    return sum(hit), len(hit) - sum(hit)


def _grow(rows, names, cuts, most_tests: int) -> list:
    tests: list = []
    inside = rows
    while len(tests) < most_tests and any(not bad for _, bad in inside):
        p, n = sum(b for _, b in inside), sum(not b for _, b in inside)
        if not p:
            break
        base, best = math.log2(p / (p + n)), (0.0, None)
        for f in names:
            line = sorted((x[f], b) for x, b in inside)
            k, bad, good = 0, 0, 0
            for cut in cuts[f]:
                while k < len(line) and line[k][0] <= cut:
                    bad, good, k = bad + line[k][1], good + (not line[k][1]), k + 1
                for sign, q, m in (("<=", bad, good), (">", p - bad, n - good)):
                    if q and (gain := q * (math.log2(q / (q + m)) - base)) > best[0] + 1e-9:
                        best = (gain, (f, sign, cut))
        if best[1] is None:
            break
        tests.append(best[1])
        inside = [(x, b) for x, b in inside if Rule((best[1],)).covers(x)]
    return tests


def learn(rows: list[tuple[dict[str, float], bool]], most_rules: int = 12, most_tests: int = 4, cuts_per_feature: int = 64, purity: float = 0.9) -> list[Rule]:
    """An ordered list of rules that reject; rows: (features, bad).

    Every third row prunes, the others grow. A rule is kept while its purity is
    `purity` or more on the pruning rows, and a tenth less at least on all, smoothed
    by Laplace's rule, which few rows do not reach. No bad rows, no rules.
    """
    names = [f for f in FEATURES if rows and f in rows[0][0]]
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if not i % 3]
    rules: list[Rule] = []
    while len(rules) < most_rules and any(b for _, b in grow):
        cuts = {}
        for f in names:
            seen = sorted({x[f] for x, _ in grow})
            mids = [(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)]
            cuts[f] = mids[:: max(1, len(mids) // cuts_per_feature)]
        tests = _grow(grow, names, cuts, most_tests)
        if not tests:
            break

        def worth(t) -> float:
            p, n = _counts(t, prune)
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        p, n = _counts(tests, prune)
        q, m = _counts(tests, grow)
        if not p or p < purity * (p + n) or (p + q + 1) / (p + q + n + m + 2) < purity - 0.1:
            break
        rules.append(Rule(tuple(tests)))
        grow = [r for r in grow if not rules[-1].covers(r[0])]
        prune = [r for r in prune if not rules[-1].covers(r[0])]
    return rules


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", good: str = "quality", most_labelled: int = 20_000, seed: int = 11, **learning) -> list[Rule]:
    """Rules from the labelled rows of df (label 0 is bad, others good; null labels are unused).

    At most `most_labelled` labels, those of the least seeded hash, are used:
    the bound of the broadcast, of the driver's memory and of the learning time.
    """
    picked = (
        labels.select(F.col(id_col).alias("_id"), F.col(good).alias("_good"))
        .dropna()
        .orderBy(F.xxhash64(F.lit(seed), "_id"), "_id", "_good")
        .limit(most_labelled)
    )
    rows = df.select(F.col(id_col), F.col(text)).join(F.broadcast(picked), F.col(id_col) == F.col("_id"))
    # staged, so that only labelled texts are counted, whatever the optimizer moves where
    got = statistics(common.stage(rows, "labelled"), text).where(~base_failed()).select(
        F.col(f"row.`{id_col}`").alias("id"), (F.col("row._good") == 0).alias("bad"), *[c.alias(n) for n, c in features().items()]
    )
    table = sorted(got.collect(), key=lambda r: (r["id"], r["bad"], r["n_words"]))
    return learn([({f: float(r[f]) for f in FEATURES}, bool(r["bad"])) for r in table], **learning)


def verdict(rules: list[Rule]) -> Column:
    """kept: the ordered conditional expression of the list; what no rule rejects is kept."""
    values = features()
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(values), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """statistics(df) with base_failed and kept."""
    return statistics(df, text).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})
