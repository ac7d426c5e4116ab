"""Golden values, NumPy cross-checks and edge cases of the operators."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arclume.functions import arrays as A
from arclume.functions import text as T
from arclume.operators import context, relational, temporal
from arclume.operators import vector as V
from arclume.operators.metrics import ranking_metrics
from arclume.operators.prototypes import kmeans

E1, E2 = np.eye(3)[:1], np.eye(3)[1:2]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("text,frames", [("50-52;60-61", [50, 51, 52, 60, 61]), ("50-52; 60-61", [50, 51, 52, 60, 61]), ("10-5", []), ("0", []), ("", []), (None, []), ("1-2-3;7-8", [7, 8]), ("a-b;3-4", [3, 4]), ("12.5-13;1-1", [1]), ("1-5,7-9", []), (" +1 - 2 ", [1, 2])])
def test_strict_ranges(spark, text, frames):
    assert one(spark, T.frame_list(T.range_list(F.lit(text).cast("string"), ";"), F.lit(10_000)))[0] == frames


def test_either_separator(spark):
    assert one(spark, T.frame_list(T.any_range_list(F.lit("1-3,7-9")), F.lit(9)))[0] == [1, 2, 3, 7, 8]


@pytest.mark.parametrize("n,count", [(0, 0), (3, 0), (4, 1), (24, 1), (27, 1), (28, 2), (50, 2), (52, 3)])
def test_clip_counts(spark, n, count):
    assert one(spark, F.size(temporal.clips(F.lit(n))))[0] == count


@pytest.mark.parametrize("n,want", [(4, [0, 1, 2, 3]), (5, [0, 1, 2, 4]), (10, [0, 3, 6, 9]), (24, [0, 7, 15, 23])])
def test_sampling(spark, n, want):
    assert one(spark, A.sample_indices(F.lit(n), 4))[0] == want


@pytest.mark.parametrize("s,want", [(5.9, "5s"), (65, "1m05s"), (3600, "1h00m"), (7384, "2h03m"), (0, "0s")])
def test_durations(spark, s, want):
    assert one(spark, T.format_time(F.lit(s)))[0] == want


@pytest.mark.parametrize("text,want", [('<Think>[1]</Think>x[{"a":1}]y', '[{"a":1}]'), ("no brackets", None), ("[broken", None), ("[]", "[]"), (None, None)])
def test_answers(spark, text, want):
    assert one(spark, T.clean_answer(F.lit(text).cast("string")))[0] == want


@pytest.mark.parametrize("name,want", [("a_clip0001_02.jpg", ("a", 1, 2)), ("a_clip_x_clip12345_7.jpg", ("a_clip_x", 12345, 7)), ("a_clipx_1.jpg", None), ("noclip.jpg", None), (None, None)])
def test_frame_names(spark, name, want):
    got = one(spark, T.parse_frame_name(F.lit(name).cast("string")))[0]
    assert (tuple(got) if got else None) == want


def test_padding_and_markers(spark):
    r = one(spark, A.pad_to_k(F.array(F.lit(1), F.lit(2)), 4), A.pad_to_k(F.array().cast("array<int>"), 4), A.marker_positions(F.array(*[F.lit(x) for x in (1, 9, 9, 2, 1, 8, 2)]), 1, 2, 2), A.marker_positions(F.array(F.lit(1)), 1, 2, 1), A.shape_text(F.array(F.lit(3), F.lit(4))))
    assert list(r) == [[1, 2, 2, 2], [], [1, 2, 5], None, "[3, 4]"]


def test_sphere_golden_values():
    near = float(np.arccos(1 - 1e-7))
    assert V.geodesic(E1, E1)[0, 0] == pytest.approx(near) and V.geodesic(E1, E2)[0, 0] == pytest.approx(np.pi / 2)
    assert V.log_map(E2, E1)[0] == pytest.approx([0, np.pi / 2, 0])
    assert V.log_map(E1, E1)[0] == pytest.approx([near, 0, 0], abs=1e-8)
    assert V.log_map(-E1, E1)[0] == pytest.approx([near - np.pi, 0, 0], abs=1e-6)
    assert V.log_map(np.zeros((1, 3)), E1)[0] == pytest.approx([0, 0, 0])
    assert V.slerp(E1, E2, 0.5)[0] == pytest.approx([0.5**0.5, 0.5**0.5, 0])
    assert V.slerp(E1, E2, 0)[0] == pytest.approx(E1[0]) and V.slerp(E1, E2, 1)[0] == pytest.approx(E2[0])
    at = lambda d: np.array([[np.cos(d), np.sin(d), 0]])
    for dn, da, want in ((0.5, 0.5, 0.4999999975), (1.0, 0.5, 0.8411308880), (0.5, 1.0, 0.1588691035)):
        assert V.vmf(E1, at(dn), at(-da))[0] == pytest.approx(want, abs=1e-9)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_sphere_properties(seed):
    rng = np.random.default_rng(seed)
    x, mu = V.normalize(rng.standard_normal((5, 8))), V.normalize(rng.standard_normal((1, 8)))
    assert np.linalg.norm(V.slerp(x, mu, rng.random()), axis=1) == pytest.approx(np.ones(5))
    assert V.exp_map(V.log_map(x, mu), mu) == pytest.approx(x, abs=1e-6)


def test_means_and_prototypes(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([V.normalize(c + 0.1 * rng.standard_normal((40, 6))) for c in np.eye(6)[:3]])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(None, [1.0] * 6), (999, None)], "id long, v array<double>").repartition(5)
    mu = V.frechet_mean(df.where("id is not null"), "v")
    want = V.normalize(x.mean(0))
    for _ in range(5):
        want = V.exp_map(V.log_map(x, want).mean(0), want)
    assert mu == pytest.approx(want, abs=1e-10)
    c = kmeans(df, "id", "v", 3)
    assert sorted(np.argmax(c, axis=1)) == [0, 1, 2] and np.linalg.norm(c, axis=1) == pytest.approx(np.ones(3))
    assert kmeans(df, "id", "v", 3, spherical=False).shape == (3, 6)
    assert kmeans(df.limit(0), "id", "v", 3).size == 0 and V.frechet_mean(df.limit(0), "v").size == 0


def test_ranking_metrics(spark):
    rows = [("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.8, 1), ("a", 0.4, 1), ("a", 0.4, 0), ("a", 0.1, 0), ("b", 0.5, 1), ("c", 0.5, 0), ("a", None, 1), ("a", 0.3, None)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: (r.ap, r.auc) for r in ranking_metrics(df, ["g"], "s", "y").collect()}
    assert got["a"] == (pytest.approx(0.7555555556), pytest.approx(0.7777777778))
    assert got["b"] == (pytest.approx(1.0), None) and got["c"] == (None, None)
    rng = np.random.default_rng(0)
    s, y = rng.random(3000).round(2) ** 3, rng.integers(0, 2, 3000)
    r = ranking_metrics(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int"), [], "s", "y").first()
    pos, neg = s[y == 1], s[y == 0]
    assert r.auc == pytest.approx(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2))
    assert ranking_metrics(df.limit(0), [], "s", "y").first()[:] == (None, None)


@pytest.mark.parametrize("n,sigma,block", [(1, 2, 100), (5, 4, 100), (300, 3, 40), (129, 3, 64), (97, 3, 32), (50, 0, 10)])
def test_smoothing(spark, n, sigma, block):
    rng = np.random.default_rng(n)
    x = rng.random(n)
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / max(sigma, 1e-9)) ** 2)
    want = np.convolve(np.pad(x, r, mode="symmetric"), w / w.sum(), mode="valid")
    df = spark.createDataFrame([("v", i * 10, float(v)) for i, v in enumerate(x)] + [("const", i, 2.5) for i in range(9)], "video string, at long, s double")
    got = {k: g.sort_values("pos")["smoothed"].to_numpy() for k, g in temporal.smooth(df, "video", "at", "s", sigma, block).toPandas().groupby("video")}
    assert got["v"] == pytest.approx(want) and got["const"] == pytest.approx([2.5] * 9)


def test_enhance_in_one_piece_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m, h = V.normalize(rng.standard_normal((90, 5))), V.normalize(rng.standard_normal((90, 5)))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(m, h))], "id long, m array<double>, h array<double>")
    s = h @ h.T
    want = m.copy()
    for i in range(90):
        at = [j for j in sorted(range(90), key=lambda j: (-s[i, j], j)) if j != i and s[i, j] >= 0.3][:4]
        if at:
            want[i] = V.normalize(0.6 * m[i] + 0.4 * (s[i, at] @ m[at]) / s[i, at].sum())
    for most in (1 << 20, 2000):
        monkeypatch.setattr(context, "MOST_SHARED", most)
        got = {r.id: r.enhanced for r in context.enhance(df, "id", "m", "h", 0.4, 0.3, 4).collect()}
        assert np.array([got[i] for i in range(90)]) == pytest.approx(want)


def test_guided_pull(spark):
    normal, abnormal = np.eye(4)[:2], np.eye(4)[2:]
    rows = [("v", 0, [1.0, 0.0, 0.0, 0.0], 0.1), ("v", 1, [0.0, 0.0, 1.0, 0.0], 0.9), ("v", 2, [0.0, 0.0, 0.9, 0.1], 0.9), ("v", 3, [0.1, 0.0, 0.9, 0.0], 0.9), ("v", 4, [0.6, 0.0, 0.0, 0.8], 0.5), ("w", 0, [0.0, 1.0, 0.0, 0.0], 0.5)]
    df = spark.createDataFrame(rows, "video string, id int, x array<double>, s double")
    got = {(r.video, r.id): r for r in context.guided_pull(df, "video", "id", "x", "s", normal, abnormal, 0.4, 0.6, 0.5).collect()}
    assert got["v", 0].is_abnormal and not got["w", 0].is_abnormal
    assert got["v", 0].pulled == [1.0, 0, 0, 0]
    assert got["v", 4].pulled == pytest.approx(V.slerp(np.array([[0.6, 0, 0, 0.8]]), abnormal[:1], 0.5)[0])
    assert context.ambiguity(df.limit(0), "s") == (0.0, 1.0)


def test_relational_edges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(2, 0), (2, 1), (None, 2)], "k int, w int")
    assert sorted(r.v for r in relational.only_with(a, b, ["k"]).collect()) == ["y", "y"]
    assert sorted(r.v for r in relational.only_without(a, b, ["k"]).collect()) == ["x", "z"]
    old = spark.createDataFrame([("a", 1, "o"), ("b", 9, "o")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "n"), ("a", 1, "late"), ("c", 1, "n")], "k string, t int, v string")
    assert sorted(tuple(r) for r in relational.upsert(old, new, ["k"], "t").collect()) == [("a", 2, "n"), ("b", 9, "o"), ("c", 1, "n")]
    chunks = relational.split_evenly(spark.range(10).select(F.lit("k").alias("k"), "id"), "k", "id", 4).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in chunks] == [3, 3, 2, 2]
    offsets = relational.running_offsets(spark.createDataFrame([(i * 7, i) for i in range(100)], "o long, n long"), "o", "n", 8).orderBy("o").toPandas()
    assert list(offsets["end_at"]) == list(pd.Series(range(100)).cumsum())
    assert relational.running_offsets(spark.createDataFrame([], "o long, n long"), "o", "n").collect() == []


def test_merged_ranges(spark):
    def merged(pairs, universe=None):
        a = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in pairs]) if pairs else F.array().cast("array<struct<s: int, e: int>>")
        m = T.merged_ranges(a, None if universe is None else F.lit(universe))
        r = spark.range(1).select(m.alias("m"), T.covered_frames(m).alias("n")).first()
        return [tuple(x) for x in r.m], r.n

    assert merged([]) == ([], 0)
    assert merged([(5, 9), (1, 3), (4, 4), (20, 30), (22, 25)]) == ([(1, 9), (20, 30)], 20)
    assert merged([(1, 999_999_999), (3, 4)], 10) == ([(1, 9)], 9)  # a range of a billion frames makes none of them
    assert merged([(12, 15)], 10) == ([], 0)


def test_positions(spark):
    rows = [("a", i) for i in range(500)] + [("b", 3), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(7)
    got = sorted((str(r.k), r.o, r.position) for r in relational.positions(df, ["k"], ["o"]).collect())
    assert got == sorted([("a", i, i) for i in range(500)] + [("b", 3, 0), ("None", 1, 0), ("None", 2, 1)])
    assert [r.position for r in relational.positions(df.where("k = 'a'"), [], ["o"]).orderBy("o").collect()] == list(range(500))
    assert relational.positions(df.limit(0), ["k"], ["o"]).count() == 0


def test_exact_median(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(context, "FEW", 10)
    monkeypatch.setattr(context, "BINS", 8)
    for values in (rng.standard_normal(1001), rng.standard_normal(1000), rng.integers(0, 3, 500) * 1.0, np.full(50, 2.5), np.array([1.0, 2.0]), np.array([7.0]), np.concatenate([np.zeros(500), rng.random(500) + 5]), np.exp(rng.standard_normal(3000) * 9)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "s double")
        assert context.exact_median(df, F.col("s")) == np.median(values)
    assert context.exact_median(spark.createDataFrame([(None,)], "s double"), F.col("s")) is None


def test_kmeans_here_and_there(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(rng.standard_normal((300, 5)))], "id long, v array<double>").repartition(3)
    for spherical in (True, False):
        here = kmeans(df, "id", "v", 4, 12, spherical)
        monkeypatch.setattr(V, "HERE", 0)
        assert np.allclose(here, kmeans(df, "id", "v", 4, 12, spherical), atol=1e-9)
        monkeypatch.undo()
    here = V.frechet_mean(df, "v")
    monkeypatch.setattr(V, "HERE", 0)
    assert np.allclose(here, V.frechet_mean(df, "v"), atol=1e-12)


def test_smoothing_of_a_long_key(spark):
    """A key longer than a block is ranked and smoothed in parts."""
    rng = np.random.default_rng(8)
    x = rng.random(700)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0)], "k string, o int, v double").repartition(5)
    got = {(r.k, r.pos): r.smoothed for r in temporal.smooth(df, "k", "o", "v", 5, block=100).collect()}
    want = temporal.smooth_values(x, 5)
    assert all(abs(got["a", i] - w) < 1e-12 for i, w in enumerate(want)) and got["b", 0] == 1.0
