"""Exact order statistics against numpy, on ties, nulls, tiny and huge numbers, whatever the slices."""

from __future__ import annotations

import numpy as np
import pytest

from pitchline.operators.selection import order_statistics


@pytest.mark.parametrize("slices", [2, 7, 2048])
def test_against_numpy(spark, slices):
    rng = np.random.default_rng(6)
    n = 300 if slices > 2 else 90
    x = {
        "even": rng.normal(size=n),
        "ties": rng.integers(0, 4, n).astype(float),
        "skewed": np.exp(30 * rng.normal(size=n)),
        "huge": rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324], n),
        "one": np.full(n, 3.25),
    }
    missing = rng.random(n) < 0.2
    data = [tuple(None if missing[i] and k != "one" else float(v[i]) for k, v in x.items()) for i in range(n)] + [(float("nan"), None, None, None, None)]
    df = spark.createDataFrame(data, ", ".join(f"{k} double" for k in x)).repartition(3)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    found = order_statistics(df, dict.fromkeys(x, shares), slices)
    for k, v in x.items():
        own = np.sort(v if k == "one" else v[~missing])
        for share, got in zip(shares, found[k]):
            p = share * (len(own) - 1)
            a, b = own[int(p)], own[min(int(p) + 1, len(own) - 1)]
            assert got == (a if p == int(p) else a + (p - int(p)) * (b - a)), (k, share)


def test_without_values(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a double, b int")
    assert order_statistics(df, {"a": [0.5], "b": [0.5]}) == {"a": [None], "b": [1.5]}
    assert order_statistics(df.limit(0), {"b": [0.0, 1.0]}) == {"b": [None, None]}
    assert order_statistics(df, {}) == {}


def test_infinite_values_are_refused(spark):
    with pytest.raises(ValueError):
        order_statistics(spark.createDataFrame([(float("inf"),), (1.0,)], "a double"), {"a": [0.5]})
