import random

import pytest

from arclume.operators.coverage import merge_intervals


def brute(rows):
    marked = {}
    for k, s, e in rows:
        if s is not None and e is not None:
            marked.setdefault(k, set()).update(range(s, e + 1))
    out = []
    for k, m in marked.items():
        if not m:
            continue
        runs, f = [], sorted(m)
        a = p = f[0]
        for x in f[1:]:
            if x != p + 1:
                runs.append((a, p))
                a = x
            p = x
        runs.append((a, p))
        out += [(k, "period", *r) for r in runs] + [(k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])]
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("width", [1, 4, 64, 8192])
def test_brute_force(spark, width):
    rng = random.Random(width)
    rows = []
    for _ in range(600):
        k = rng.choice(["hub"] * 6 + ["a", "b", "c", None, ""])
        s = rng.randint(-30, 900)
        rows.append((k, s, s + rng.choice([-3, 0, 1, 2, 5, 9, 40])))
    rows += [("a", None, 3), ("a", 3, None), ("none", None, None), ("rev", 5, 4), ("long", 0, 700), ("long", 3, 4)] + rows[:40]
    df = spark.createDataFrame([(k, s, e, 1, "x") for k, s, e in rows], "video string, start_frame int, end_frame int, shard int, kind string")
    got = [tuple(r) for r in merge_intervals(df, ["video"], "start_frame", "end_frame", width).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_neighbours_join_across_borders(spark):
    df = spark.createDataFrame([("v", 0, 7), ("v", 8, 15), ("v", 17, 17)], "v string, s int, e int")
    got = sorted(tuple(r) for r in merge_intervals(df, ["v"], "s", "e", 8).collect())
    assert got == [("v", "gap", 16, 16), ("v", "period", 0, 15), ("v", "period", 17, 17)]


def test_empty(spark):
    df = spark.createDataFrame([], "v string, s int, e int")
    assert merge_intervals(df, ["v"], "s", "e").collect() == []
