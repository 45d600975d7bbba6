"""Series operators against plain loops, positions with ties, and plans."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from funcframe import operators as ops
from funcframe.dataset import Dataset
from funcframe.operators import series
from funcframe.plans import sequence


def plain_kept(values, last, delta):
    out = []
    for v in values:
        ok = last is None or not abs(v - last) > delta
        out.append(ok)
        last = v if ok else last
    return out, last


NUMBER = st.one_of(st.integers(-30, 30).map(float), st.floats(-30, 30), st.sampled_from([math.nan, math.inf, -math.inf, 1e9, 0.1, 0.2, 0.3]))


@settings(max_examples=300, deadline=None)
@given(st.lists(NUMBER, max_size=40), st.lists(NUMBER, max_size=40), st.lists(NUMBER, min_size=1, max_size=8), st.sampled_from([0.0, 0.1, 1.0, 5.0]))
def test_steps_equal_the_loop(a, b, starts, delta):
    one, two = (series.Steps.of(np.array(v, dtype=float), delta) for v in (a, b))
    for start in (*starts, None):
        for run, s in ((a, one), (b, two), (a + b, one.then(two))):
            if run or start is not None:
                want = plain_kept(run, start, delta)[1]
                got = s(start) if run else start
                if a and b or run is not a + b:
                    assert got == want or math.isnan(got) and math.isnan(want)


def test_steps_stay_few():
    rng = np.random.default_rng(1)
    for v in (rng.uniform(0, 100, 30_000), np.arange(30_000) * 0.01, np.cumsum(rng.normal(size=30_000)), np.where(np.arange(30_000) % 7 == 3, 1e6, rng.uniform(0, 9, 30_000))):
        assert len(series.Steps.of(v, 5.0).low) < 300


@pytest.mark.parametrize("stuck", [False, True])
def test_max_delta_over_many_blocks(spark, monkeypatch, stuck):
    """Groups of few small blocks; with a value stuck far off, all others are left out."""
    for module in (series, sequence):
        monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(series.MaxDelta, "GROUP", 4)
    rng = np.random.default_rng(2)
    v = np.cumsum(rng.normal(scale=3, size=900))
    if stuck:
        v[0] = 1e6
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "x long, a double")
    got = sorted(r.x for r in Dataset.of("d", "x: long -> a: double", df).max_delta("a", 2).samples(sort=False).collect())
    assert got == [i for i, k in enumerate(plain_kept(v.tolist(), None, 2)[0]) if k]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 9, 12, 50])
def test_drops_with_ties_and_nulls(spark, n):
    """As many rows go as were asked for, those of the least keys, also where keys repeat."""
    keys = [None, None, 1, 1, 1, 2, 3, 3, 4, 5, 5, 5]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "x int, a int")
    rank = lambda k: (k is not None, k or 0)
    for op, back in ((ops.Drop(n), False), (ops.DropRight(n), True)):
        got = [r.x for r in Dataset.of("d", "x -> a", df).with_operation(op).with_order().collect()]
        assert sorted(got, key=rank) == sorted(sorted(keys, key=rank, reverse=back)[n:], key=rank)


def test_drop_does_not_sort_the_rest(spark):
    d = Dataset.of("d", "x: long -> a: long", spark.range(1000).selectExpr("id AS x", "id AS a"))
    plan = d.drop(10).with_order()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_nesting_and_laying_out_again_takes_no_arrays(spark):
    df = spark.createDataFrame([(1, 1, "u", 5), (1, 2, "v", 6), (2, 1, None, 7)], "x int, y int, t string, a int")
    d = Dataset.of("d", "(x, y) -> (t: string, a)", df)
    for made, want in ((d.group_by("t"), [("u", 1, 1, 5), ("v", 1, 2, 6)]), (d.curry(1), [(1, 1, "u", 5), (1, 2, "v", 6), (2, 1, None, 7)]), (d.curry_right(1), [(1, 1, "u", 5), (1, 2, "v", 6), (2, 1, None, 7)])):
        flat = made.uncurry()
        arrays = flat.model, sorted(map(repr, map(tuple, ops.Uncurry().apply(made.with_order(), made.model).collect())))
        assert arrays == (flat.model, sorted(map(repr, map(tuple, flat.samples(sort=False).collect())))) and sorted(map(repr, want)) == arrays[1]
        assert "collect_list" not in flat.with_order()._jdf.queryExecution().optimizedPlan().toString()
