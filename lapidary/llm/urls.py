"""URL filters by host rules and path-template trees.

Per host, paths form a tree of segments. Segments that look generated (numbers,
hexadecimal names) become typed wildcards at once; then, level by level, the
children of a node that are too many and too rare become one wildcard, and
literal children whose labelled share of bad pages does not differ
significantly from that of their siblings merge into one branch. A template is
rejected if its labelled share of bad pages, smoothed towards its host's and
that towards all hosts', is over a threshold.

All is counted over distinct (host, shape) pairs, pre-aggregated before any
shuffle by host, so a hot host is many small rows and never one task's group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://; empty for null or without it. No pattern repeats a group: those recurse once a character."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path start) that fits host or a parent domain; else nulls."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return none if out is None else out.otherwise(none)


def shape_of(path: Column) -> Column:
    """The segments of a path, generated-looking ones as typed wildcards."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    typed = lambda s: (
        F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), F.regexp_replace(s, "^[0-9]+", "{n}"))
        .when(s.rlike(r"^[0-9A-Fa-f-]{8,}$"), F.lit("{x}"))
        .otherwise(s)
    )
    return F.transform(segments, typed)


def templates(
    urls: DataFrame,
    labelled: DataFrame,
    most_children: int = 32,
    rare: float = 0.02,
    z: float = 2.58,
    weight: float = 8.0,
    threshold: float = 0.5,
) -> DataFrame:
    """(host, shape) -> template, purity (smoothed share of bad) and reject, for all hosts and shapes of urls.

    urls: column url. labelled: url, bad (boolean; null unused). Paths are gone
    through to their last segment; a path that is alone below its node keeps what is
    left of its shape, so late levels hold only paths that still share a node.
    With no labels at all nothing is rejected.
    """
    key = lambda df: df.select(host_of(F.col("url")).alias("host"), shape_of(path_of(F.col("url"))).alias("shape"), "lab", "bad", "n")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    all_urls = urls.select("url", zero.alias("lab"), zero.alias("bad"), one.alias("n"))
    marked = labelled.where(F.col("bad").isNotNull()).select("url", one.alias("lab"), F.col("bad").cast("long").alias("bad"), zero.alias("n"))
    tree = key(all_urls).unionByName(key(marked)).groupBy("host", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "lab", "bad")])
    tree = common.stage(tree.withColumn("template", F.lit("")), "url-tree")
    ready, d = None, 0
    while True:
        here = tree.withColumn("child", F.try_element_at("shape", F.lit(d + 1)))
        counts = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
        child = here.where("child IS NOT NULL").groupBy("host", "template", "child").agg(F.count(F.lit(1)).alias("paths"), *counts)
        node = child.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("kids"), F.sum("paths").alias("all_paths"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "lab", "bad")]
        )
        both = child.join(node, ["host", "template"])
        rest_lab, rest_bad = F.col("all_lab") - F.col("lab"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide(F.col("all_bad"), F.col("all_lab"))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("lab")) + F.try_divide(F.lit(1), rest_lab)))
        gap = F.abs(F.try_divide(F.col("bad"), F.col("lab")) - F.try_divide(rest_bad, rest_lab))
        differs = F.coalesce(F.try_divide(gap, spread) > z, F.lit(False))
        variable = (F.col("kids") > most_children) & (F.col("n") < rare * F.col("all_n"))
        branch = (
            F.when(F.startswith("child", F.lit("{")), F.col("child"))
            .when(differs, F.col("child"))
            .when(variable, F.lit("*"))
            .when(F.col("kids") > 1, F.lit("~"))
            .otherwise(F.col("child"))
        )
        moves = both.select("host", "template", "child", branch.alias("branch"), (F.col("all_paths") == 1).alias("alone"))
        step = here.join(moves, ["host", "template", "child"], "left")
        tail = F.array_join(F.slice("shape", F.lit(d + 1), F.greatest(F.size("shape") - d, F.lit(0))), "/")
        grown = F.when(F.col("branch").isNull(), F.col("template")).when(F.col("alone"), F.concat("template", F.lit("/"), tail)).otherwise(
            F.concat("template", F.lit("/"), "branch")
        )
        through = F.col("branch").isNull() | F.col("alone")
        step = common.stage(step.select("host", "shape", "n", "lab", "bad", grown.alias("template"), through.alias("ready")), "url-tree")
        over = step.where("ready").drop("ready")
        ready = over if ready is None else ready.unionByName(over)
        tree, d = step.where("NOT ready").drop("ready"), d + 1
        if tree.isEmpty():
            break
    tree = ready
    leaf = tree.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    hosts = tree.groupBy("host").agg(F.sum("lab").alias("host_lab"), F.sum("bad").alias("host_bad"))
    lab, bad = tree.agg(F.sum("lab"), F.sum("bad")).first()
    base = (bad or 0) / lab if lab else 0.0
    host_rate = (F.col("host_bad") + weight * base) / (F.col("host_lab") + weight)
    purity = (F.col("bad") + weight * host_rate) / (F.col("lab") + weight)
    judged = leaf.join(hosts, "host").select("host", "template", purity.alias("purity"), (purity > threshold).alias("reject"))
    return tree.select("host", "shape", "template").join(judged, ["host", "template"])


def judge(df: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", **tree) -> DataFrame:
    """df's columns in the struct `row`, with host, path, rule, template, purity and verdict.

    verdict: the rule's, else block for rejected templates and allow for others.
    Null urls have empty host and path, and the template of the empty path.
    Repeated rows stay; other columns travel inside `row`.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    u = F.col(f"row.`{url}`")
    rows = df.select(row.alias("row")).withColumns({"host": host_of(u), "path": path_of(u)})
    found = templates(df.select(F.col(f"`{url}`").alias("url")), labelled, **tree)
    rows = rows.withColumns({"ruled": rule_of(F.col("host"), F.col("path"), rules), "shape": shape_of(F.col("path"))})
    joined = rows.join(common.small(common.stage(found, "url-templates")), ["host", "shape"])
    method = F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "row", "host", "path", F.col("ruled.rule").alias("rule"), "template", "purity", F.coalesce(F.col("ruled.verdict"), method).alias("verdict")
    )
