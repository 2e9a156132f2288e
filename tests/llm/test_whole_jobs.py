"""Cases in which a cap, a cut or a shortened table once lost part of the result."""

import random


from lapidary.llm import similarity


# ---- similarity


def test_buckets_split_until_they_fit(spark):
    rng = random.Random(5)
    sets = [(i, rng.sample(range(192), 64)) for i in range(120)]  # each token is in a third of the sets
    reps = spark.createDataFrame(sets, "uid long, sample array<long>")
    final, _, levels = similarity._split(spark.range(6).toDF("path").crossJoin(reps.select("uid")), reps, 4, 1.25)
    assert levels > 4
    assert max(r["count"] for r in final.groupBy("path").count().collect()) <= 4


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.uid: r.label for r in similarity.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)}


def test_runs_reach_the_recall_at_any_depth():
    """Chances by each level's own child rate, for a set and a subset of it at the threshold."""
    for depth in (1, 2, 4, 9, 30):
        meet = 1.0
        for level in reversed(range(depth)):
            meet = 1 - 2.718281828459045 ** (-0.8 * (1.5 if level else 1.25) * meet)
        runs = similarity.runs_for(0.9999, 0.8, 1.25, 4 if depth <= 4 else None)
        assert 1 - (1 - meet) ** runs >= 0.9999
