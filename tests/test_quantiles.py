"""Exact quantiles against numpy."""

import random

import numpy as np
import pytest

from lapidary.operators.quantiles import quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("most", [3, 50, 20_000])
@pytest.mark.parametrize("kind", ["even", "skewed", "few", "one", "pair"])
def test_against_numpy(spark, most, kind):
    rng = random.Random(3)
    values = {
        "even": [rng.random() for _ in range(20_000)],
        "skewed": [rng.lognormvariate(0, 4) for _ in range(5_000)] + [0.0] * 3_000,
        "few": [float(rng.randrange(5)) for _ in range(3_000)],
        "one": [7.0],
        "pair": [1.0, 2.0],
    }[kind]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None)], "a double, b double").repartition(4)
    got = quantiles(df, {"a": SHARES, "b": [0.5]}, most)
    assert got["b"] == [None]
    assert np.allclose(got["a"], np.quantile(values, SHARES), rtol=1e-12, atol=0)
