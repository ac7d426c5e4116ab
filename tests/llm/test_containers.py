import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arclume.llm.containers import best_fill, pack, plan


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 30))
def test_best_fill_is_optimal(counts, room):
    fill = best_fill(counts, room)
    assert all(0 < c <= counts[k] for k, c in fill.items())
    best = max(s for s in (sum(k * c for k, c in zip(counts, cs)) for cs in itertools.product(*(range(v + 1) for v in counts.values()))) if s <= room)
    assert sum(k * c for k, c in fill.items()) == best


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=20))
def test_plan_uses_every_item_once(histogram):
    used = Counter()
    for times, fill in plan(histogram, 50):
        assert times > 0 and sum(k * c for k, c in fill.items()) <= 50
        for k, c in fill.items():
            used[k] += c * times
    assert used == Counter(histogram)


def first_fit_decreasing(sizes, capacity):
    parts = sorted((min(capacity, s - a) for s in sizes if s and s > 0 for a in range(0, s, capacity)), reverse=True)
    full = sum(p == capacity for p in parts)
    bins = []
    for p in parts[full:]:
        for i, b in enumerate(bins):
            if b + p <= capacity:
                bins[i] += p
                break
        else:
            bins.append(p)
    return full + len(bins)


@pytest.mark.parametrize("partitions", [1, 5])
def test_pack(spark, partitions):
    rng = random.Random(1)
    sizes = [None, 0, -3, 1, 100, 101, 250, 10**6] + [rng.choice([7] * 9 + [3, 40, 60, 99]) for _ in range(3000)]
    df = spark.createDataFrame([(i, s, 1, "x") for i, s in enumerate(sizes)], "doc long, size long, container_id int, n string").repartition(partitions)
    rows = pack(df, "doc", "size", 100).collect()
    load, own = Counter(), {}
    for r in rows:
        own.setdefault(r.doc, []).append((r.part_no, r.start, r.n))
        if r.container_id is not None:
            load[r.container_id] += r.n
    assert max(load.values()) <= 100 and set(load) == set(range(1, len(load) + 1))
    for i, s in enumerate(sizes):
        parts = sorted(own[i])
        if not s or s < 0:
            assert parts == [(1, 0, 0)]
        else:
            assert [p[1:] for p in parts] == [(a, min(100, s - a)) for a in range(0, s, 100)]
    assert len(load) <= first_fit_decreasing(sizes, 100)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc long, size int"), "doc", "size").collect() == []
