import numpy as np
import pytest
from pyspark import cloudpickle

from arclume.llm import clusters as C
from arclume.llm import vectors as V
from arclume.llm.clusters import average_linkage, components, describe, vector_clusters


def brute_pairs(ids, x, threshold, k=10):
    u = V.unit(x)
    out = set()
    for i in range(len(ids)):
        # pair by pair, not as one product of matrices, whose last digits depend on the place in it
        s = np.round(np.einsum("j,ij->i", u[i], u), V.DIGITS)
        s[i] = -2
        order = np.lexsort((ids, -s))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[j] >= threshold}
    return out


def brute_clusters(ids, x, threshold, least=3):
    u = V.unit(x)
    s = u @ u.T
    root = {int(i): int(i) for i in ids}
    seen, out = set(), {}
    for a in range(len(ids)):
        if a in seen:
            continue
        group, todo = [], [a]
        seen.add(a)
        while todo:
            i = todo.pop()
            group.append(i)
            for j in np.flatnonzero(s[i] >= threshold):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        if len(group) >= least:
            first = min(int(ids[g]) for g in group)
            out |= {int(ids[g]): first for g in group}
    assert root
    return out


@pytest.fixture(scope="module")
def fixture():
    rng = np.random.default_rng(2)
    parts = [rng.standard_normal((300, 16))]
    for size, spread in ((200, 0.05), (80, 0.1), (40, 0.12), *[(6, 0.1)] * 30):
        c = rng.standard_normal(16)
        parts.append(c / np.linalg.norm(c) * (1 + rng.random((size, 1))) + spread * rng.standard_normal((size, 16)))
    x = np.concatenate(parts).astype(np.float32)
    x = np.concatenate([x, x[300:312], np.repeat(x[310:311], 90, axis=0)])
    ids = rng.permutation(len(x) * 3)[: len(x)].astype(np.int64)
    return ids, x


def frame(spark, ids, x):
    rows = [(int(i), [float(a) for a in v], 1, "x") for i, v in zip(ids, x)]
    bad = [(10**6, None), (10**6 + 1, [0.0] * 16), (10**6 + 2, [float("nan")] * 16), (10**6 + 3, [1.0, 2.0]), (10**6 + 4, []), (10**6 + 5, [float("inf")] + [1.0] * 15), (10**6 + 6, [None] + [1.0] * 15), (None, [1.0] * 16)]
    return spark.createDataFrame(rows + [(i, v, 1, "y") for i, v in bad], "clip_id long, v array<float>, home int, feat string").repartition(5)


@pytest.mark.parametrize("block", [3000, 100])
def test_search(spark, fixture, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    ids, x = fixture
    got = [tuple(r) for r in V.similar_vectors(frame(spark, ids, x), "clip_id", ["v"], 0.85).collect()]
    assert len(got) == len(set(got)) and {f for f, _, _ in got} == {"v"}
    got = {(a, b) for _, a, b in got}
    want = brute_pairs(ids, x, 0.85)
    if block == 3000:
        assert got == want
    else:
        assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("block", [3000, 100])
def test_clusters(spark, fixture, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    ids, x = fixture
    df = frame(spark, ids, x)
    members = vector_clusters(df, "clip_id", "v", 0.85, 3)
    got = {r.clip_id: r.first_id for r in members.collect()}
    assert got == brute_clusters(ids, x, 0.85)
    d = describe(df, members, "clip_id", "v", 2).collect()
    sizes = {}
    for r in d:
        sizes.setdefault(r.first_id, r.size)
        assert r.rank in (1, 2) and got[r.clip_id] == r.first_id
    assert sum(sizes.values()) == len(got)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "clip_id long, v array<float>")
    assert V.similar_vectors(df, "clip_id", ["v"]).collect() == []
    assert vector_clusters(df, "clip_id", "v").collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "clip_id long, v array<float>")
    assert V.similar_vectors(nulls, "clip_id", ["v"]).collect() == []


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1150)] + [(5000, j) for j in range(5001, 5100)] + [(7, 7), (None, 3)]
    root = {n: n for e in edges for n in e if None not in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    touched = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in touched}


def test_merging_by_reciprocal_neighbours():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 40
        i, j = rng.integers(0, n, (2, 60))
        w = rng.integers(0, 5, 60).astype(float)  # ties
        label, used = V.merge_links(n, i, j, w)
        root = np.arange(n)
        for _ in range(n):
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
        assert len({(a, b) for a, b in zip(label, root)}) == len(set(label)) == len(set(root))
        assert len(used) == n - len(set(label))  # a forest


def test_codes_keep_near_pairs():
    rng = np.random.default_rng(1)
    x = V.unit(rng.standard_normal((4000, 64)))
    model = V.fit(x[:2000], 4000)
    y = V.unit(x + 0.04 * rng.standard_normal(x.shape))
    cos = (x * y).sum(1)
    bx, by = (V.index_rows(0, model, np.arange(4000), v)[0] for v in (x, y))
    shared = (bx.reshape(-1, 4000) == by.reshape(-1, 4000)).any(0)
    assert cos.mean() > 0.9 and shared.mean() > 0.98
    assert V.radius(1.0) == 0 and V.radius(0.85) < 40
    count, bits = V.substrings(120_000, 0.85)
    assert (1 - (1 - V.differing(0.85)) ** bits) ** count <= V.MISS < (1 - (1 - V.differing(0.85)) ** bits) ** (count - 1)


def test_pigeonhole():
    """Codes that differ in fewer bits than there are substrings share one, and rows of a split value still meet all others."""
    rng = np.random.default_rng(3)
    ids = np.arange(600)
    x = V.unit(np.concatenate([rng.standard_normal((200, 64)), rng.standard_normal((1, 64)) + 0.5 * rng.standard_normal((400, 64))]))
    for chunk in (10**6, 40):
        V_chunk, V.CHUNK = V.CHUNK, chunk
        try:
            model = V.fit(x, 600)
        finally:
            V.CHUNK = V_chunk
        assert (len(model.hot) > 0) == (chunk == 40)
        code = V.place(model, x)[1]
        bucket, i, side, *code_words = V.index_rows(0, model, ids, x)
        home = (i << 2) + (side & 3)  # every row is a block
        order = np.argsort(bucket, kind="stable")
        p, q = V.compare(bucket[order], i[order], home[order], [w[order].view(np.uint64) for w in code_words], 64 * V.CODE)
        found = set(zip(p.tolist(), q.tolist()))
        count = model.count
        used = code[:, : count * model.bits]
        apart = (used[:, None, :] != used[None, :, :]).sum(2)
        near = {(int(u), int(v)) for u, v in zip(*np.nonzero(apart < count)) if u != v}
        assert near and near <= found
        values = np.stack(V._values(model, code))
        assert found == {(u, v) for u in range(600) for v in np.flatnonzero((values == values[:, u : u + 1]).any(0)).tolist() if u != v}


@pytest.fixture
def by_value():
    cloudpickle.register_pickle_by_value(V)  # or the workers would not see a patch
    yield
    cloudpickle.unregister_pickle_by_value(V)


def hot_table():
    """A group of two thirds of all rows that spans many blocks."""
    rng = np.random.default_rng(4)
    c = rng.standard_normal((1, 32))
    x = np.concatenate([rng.standard_normal((1000, 32)), 4 * c / np.linalg.norm(c) + 0.25 * rng.standard_normal((2000, 32))]).astype(np.float32)
    return rng.permutation(3000).astype(np.int64), x


def plain(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "clip_id long, v array<float>").repartition(4)


@pytest.mark.parametrize("split", [False, True])
def test_recall_of_the_index_alone(spark, monkeypatch, by_value, split):
    """Thirty blocks, most of them of one group; with ``split`` blocks in cells and substring values in chunks."""
    monkeypatch.setattr(V, "BLOCK", 100)
    monkeypatch.setattr(V, "BUCKET", 64)
    if split:
        monkeypatch.setattr(V, "CELL", 60)
        monkeypatch.setattr(V, "CHUNK", 100)
    ids, x = hot_table()
    got = [tuple(r) for r in V.similar_vectors(plain(spark, ids, x), "clip_id", ["v"], 0.85).collect()]
    assert len(got) == len(set(got))
    got, want = {(a, b) for _, a, b in got}, brute_pairs(ids, x, 0.85)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("split", [False, True])
def test_exact(spark, monkeypatch, by_value, split):
    """Whatever the index finds, all rows are compared."""
    monkeypatch.setattr(V, "BLOCK", 100)
    monkeypatch.setattr(V, "GROUP", 700)
    monkeypatch.setattr(V, "HELD", 2000)
    monkeypatch.setattr(V, "SIGMAS", -3.0)
    monkeypatch.setattr(V.search, "__defaults__", (V.K, 0.5, -3.0, V.CODE))
    if split:
        monkeypatch.setattr(V, "CELL", 60)
    ids, x = hot_table()
    got = {(a, b) for _, a, b in V.similar_vectors(plain(spark, ids, x), "clip_id", ["v"], 0.85, exact=True).collect()}
    assert got == brute_pairs(ids, x, 0.85)


def test_clusters_exact(spark, fixture, monkeypatch, by_value):
    """Links that the Hamming filter drops still join clusters."""
    monkeypatch.setattr(V, "BLOCK", 30)
    monkeypatch.setattr(V, "GROUP", 300)
    monkeypatch.setattr(V, "CELL", 20)
    monkeypatch.setattr(V, "radius", lambda threshold, sigmas, code: 2)
    ids, x = fixture
    got = {r.clip_id: r.first_id for r in vector_clusters(frame(spark, ids, x), "clip_id", "v", 0.85, 3, exact=True).collect()}
    assert got == brute_clusters(ids, x, 0.85)


def test_held_pairs_are_bounded(fixture, monkeypatch):
    monkeypatch.setattr(V, "HELD", 500)
    ids, x = fixture
    u, n = V.unit(x), 400
    out = []
    for rows, first in ((np.arange(n), n), (np.arange(n, len(x)), len(x) - n), (np.arange(len(x)), n)):
        for got in V.nearest_of_all(u[rows], ids[rows], first, np.full(len(rows), 0.85), 0.85):
            out += list(zip(*got, strict=True))
    best = {}
    for a, b, w in out:
        best.setdefault(a, []).append((-w, b))
    got = {(min(a, b), max(a, b)) for a, found in best.items() for _, b in sorted(found)[:10]}
    assert got == brute_pairs(ids, x, 0.85)


def dense_average_linkage(u, threshold):
    """One merge at a time, over all pairs."""
    groups = [[i] for i in range(len(u))]
    sums = [v.copy() for v in u]
    while len(groups) > 1:
        s, n = np.stack(sums), np.array([len(g) for g in groups])
        mean = np.round(s @ s.T / np.outer(n, n), 9)
        mean[np.tril_indices(len(s))] = -2
        i, j = np.unravel_index(mean.argmax(), mean.shape)
        if mean[i, j] < threshold:
            break
        groups[i] += groups.pop(j)
        sums[i] += sums.pop(j)
    return {frozenset(g) for g in groups if len(g) >= 3}


@pytest.mark.parametrize("few", [64 << 20, 3000, 0])
def test_average_linkage(spark, monkeypatch, few):
    """In one task, by rounds of jobs, and by some of both."""
    monkeypatch.setattr(C, "FEW_BYTES", few)
    rng = np.random.default_rng(8)
    parts = [rng.standard_normal((30, 12))]
    for size, spread in ((25, 0.45), (20, 0.3), (15, 0.55), (4, 0.1), (2, 0.1)):
        c = rng.standard_normal(12)
        parts.append(2 * c / np.linalg.norm(c) + spread * rng.standard_normal((size, 12)))
    x = np.concatenate(parts).astype(np.float32)
    x = np.concatenate([x, x[30:33]])  # repeated rows
    ids = rng.permutation(len(x)).astype(np.int64)
    u = V.unit(x)
    i, j = np.nonzero(u @ u.T >= 0.85)
    links = spark.createDataFrame([(int(ids[a]), int(ids[b])) for a, b in zip(i, j)] + [(None, 1)], "u long, v long")
    got = {}
    for r in average_linkage(frame(spark, ids, np.pad(x, ((0, 0), (0, 4)))), "clip_id", "v", links, 0.85, 3).collect():
        got.setdefault(r.first_id, []).append(r.clip_id)
    assert all(first == min(members) for first, members in got.items())
    want = {frozenset(int(ids[m]) for m in g) for g in dense_average_linkage(u, 0.85)}
    assert want and {frozenset(m) for m in got.values()} == want
    none = spark.createDataFrame([], "u long, v long")
    assert average_linkage(frame(spark, ids, np.pad(x, ((0, 0), (0, 4)))), "clip_id", "v", none).collect() == []
