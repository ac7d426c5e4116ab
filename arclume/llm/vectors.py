"""Similar vectors by multi-index hashing over learned binary codes.

1. A model is fitted on a bounded sample: spherical k-means centres, which only
   say where a vector's home block is, and iteratively quantised rotations, whose
   signs are its binary code.
2. The code is split into substrings and each of them is indexed: rows are hashed
   by substring and sorted. Two codes that differ in fewer bits than there are
   substrings share one of them (pigeonhole), so a probe of its own value in each
   finds every code within that radius, without flips; there are so many substrings
   that codes of vectors at the similarity threshold share one but for a stated
   chance. All rows of one substring value are compared by XOR and population count,
   however many they are; values that the sample shows to be frequent are compared
   chunk by chunk in several tasks. Only codes travel in this step. Its result says
   which other blocks hold codes within the radius of a vector's.
3. Each vector goes to its home block and to all blocks found. In a block all home
   vectors are compared with all others by their floats: 32-bit products choose,
   64-bit products decide. Blocks of many rows are split into cells, a part of the
   queries against a part of the others each, and the best of the cells are merged.

What is missed are neighbours whose code lies beyond the radius or shares no
substring, while none of their block is found. Where that is not enough,
``exact=True`` has ``compare_all`` compare every vector with every other one
afterwards, with what was found as limits; its time grows by the square of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of the sample the model is fitted on; at most this many, whatever the table holds.
SAMPLE = 16_000
#: Rows a home block should hold, and the most centres there are; where blocks grow beyond ``CELL`` rows they are split.
BLOCK, MAX_BLOCKS, CELL = 3_000, 16_384, 16_384
#: Rows that a substring value holds on average at most, and rows of one value that a task compares.
BUCKET, CHUNK = 2_048, 65_536
#: 64-bit words of a code that are compared.
CODE = 2
#: The chance that two vectors at the threshold share no substring, and deviations of their Hamming distance that the radius allows.
MISS, SIGMAS = 0.01, 2.5
#: Rows of a group that is compared with every other group in one task.
GROUP = 40_000
#: Pairs a task holds before it keeps only what can still count.
HELD = 2_000_000
#: Equal vectors beyond so many are searched for through their first ``K + 1``.
COPIES = 64
K = 10
SLACK = 1e-4
#: Decimals to which cosines are rounded before they are ranked, so that equal directions tie whatever the order of their sums.
DIGITS = 12


@dataclass
class Model:
    """What a worker needs to place and code vectors of one column."""

    dim: int  # length of the column's vectors
    centres: np.ndarray
    mean: np.ndarray
    rotations: np.ndarray
    count: int  # of substrings
    bits: int  # of a substring, by the size of the table
    code: int  # words of a code that are compared
    hot: dict[int, int]  # chunks of the substring values that are split
    cells: np.ndarray  # parts of each block


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the usable vectors: not null, of the given length, finite, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    dim = dim or (int(np.bincount(sizes).argmax()) if len(sizes) and sizes.max() > 0 else 1)
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(len(column), bool)
    rows = np.flatnonzero(valid & (sizes == dim))
    flat = column.values.cast(pa.float32()).to_numpy(zero_copy_only=False)  # a null element becomes NaN
    m = flat[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim), np.float32)
    good = np.isfinite(m).all(1) & (m != 0).any(1)
    return rows[good], m[good]


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(1, keepdims=True)  # no overflow of the squares
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c)
    return c


def _itq(v: np.ndarray, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """A rotation that brings ``v`` near the corners of the hypercube."""
    r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def differing(threshold: float) -> float:
    """The share of code bits in which two vectors at the threshold differ."""
    return float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)


def radius(threshold: float, sigmas: float = SIGMAS, code: int = CODE) -> int:
    """The Hamming distance of codes of ``code`` words that few pairs at the threshold exceed."""
    p, n = differing(threshold), 64 * code
    return int(np.ceil(n * p + sigmas * np.sqrt(n * p * (1 - p))))


def substrings(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(how many, of how many bits): as long as ``BUCKET`` asks for, as many as ``miss`` asks for."""
    bits = int(np.clip(np.ceil(np.log2(max(rows, 2) / BUCKET)), 4, 30))
    share = (1 - differing(threshold)) ** bits
    return max(2, int(np.ceil(np.log(miss) / np.log(1 - min(share, 0.999))))), bits


def fit(sample: np.ndarray, rows: int, threshold: float = 0.85, miss: float = MISS, code: int = CODE, seed: int = 7) -> Model:
    """The model of a sample of unit vectors of a table with ``rows`` rows."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    dim = x.shape[1]
    k = int(min(MAX_BLOCKS, max(1, -(-rows // BLOCK))))
    mean = x.mean(0)
    v = (x[:4096] - mean).astype(np.float64)
    count, bits = substrings(rows, threshold, miss)
    length = max(64 * code, count * bits)
    rotations = np.concatenate([_itq(v, rng) for _ in range(-(-length // dim))], axis=1)[:, :length].astype(np.float32)
    model = Model(dim, _kmeans(x, k, rng), mean, rotations, count, bits, code, {}, np.ones(k, np.int64))
    # the sample says what has to be split; that decides how the work is spread, not what is found
    home, bits_of = place(model, x)
    each = rows / len(x)
    model.cells = np.maximum(1, np.ceil(np.bincount(home, minlength=k) * each / CELL)).astype(np.int64)
    for j, value in enumerate(_values(model, bits_of)):
        at, n = np.unique(value, return_counts=True)
        often = n * each > CHUNK
        model.hot |= {int(b): int(np.ceil(c * each / CHUNK)) for b, c in zip(at[often], n[often])}
    return model


def place(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home block and code bits of each unit vector."""
    x = x.astype(np.float32)
    home = np.concatenate([(x[i : i + 1024] @ model.centres.T).argmax(1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)
    return home, (x - model.mean) @ model.rotations >= 0


def _values(model: Model, code: np.ndarray) -> list[np.ndarray]:
    """The value of each substring, with its place above the bits."""
    weights = 1 << np.arange(model.bits, dtype=np.int64)
    return [code[:, j * model.bits : (j + 1) * model.bits] @ weights + (j << 30) for j in range(model.count)]


def _pack(bits: np.ndarray) -> np.ndarray:
    """(rows, n / 64) 64-bit words of a matrix of n bits."""
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).reshape(len(bits), -1)


def index_rows(feat: int, model: Model, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per vector and substring: bucket, id, home block and side, the words of code.

    A split bucket's row goes to every pair of chunks that its own one is in; side 0
    is compared with side 1, and side 2 with its own. The side is the last two bits
    of the third column.
    """
    home, code = place(model, x)
    words = _pack(code[:, : 64 * model.code]).view(np.int64)
    own = ((home + feat * MAX_BLOCKS) << 2).astype(np.int32)
    bucket, side, at = [], [], []
    every = np.arange(len(ids))
    hot = np.array(sorted(model.hot), np.int64)
    for value in _values(model, code):
        split = np.isin(value, hot) if len(hot) else np.zeros(len(value), bool)
        plain = every[~split]
        bucket.append(value[plain] << 20)
        side.append(np.full(len(plain), 2, np.int32))
        at.append(plain)
        for b in np.unique(value[split]):
            rows, n = every[value == b], model.hot[int(b)]
            chunk = (mix(ids[rows].view(np.uint64)) % np.uint64(n)).astype(np.int64)
            for other in range(n):
                low, high = np.minimum(chunk, other), np.maximum(chunk, other)
                bucket.append((b << 20) + low * n + high + 1)
                side.append(np.where(chunk == other, 2, chunk > other).astype(np.int32))
                at.append(rows)
    to = np.concatenate(at)
    return np.concatenate(bucket) + (feat << 56), ids[to], own[to] + np.concatenate(side), *(words[to, i] for i in range(model.code))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _once(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[first], y[first]


def compare(bucket: np.ndarray, ids: np.ndarray, home: np.ndarray, words: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, block): which foreign blocks hold codes within ``most`` of a row's; rows are sorted by bucket, all rows of a bucket are compared."""
    home, side = home >> 2, home & 3
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
    held = 0
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for p, q in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if home[p] == home[q - 1] and (home[p:q] == home[p]).all():
            continue
        for i in range(p, q, 256):
            r = slice(i, min(i + 256, q))
            apart = np.bitwise_count(words[0][r, None] ^ words[0][None, i:q])
            for w in words[1:]:
                apart += np.bitwise_count(w[r, None] ^ w[None, i:q])
            u, v = np.nonzero(apart <= most)
            u, v = u + i, v + i
            met = (home[u] != home[v]) & ((side[u] == 2) | (side[u] != side[v]))
            u, v = u[met], v[met]
            out += [(ids[v], home[u]), (ids[u], home[v])]
            held += 2 * len(u)
            if held > HELD:
                out = [_once(out)]
                held = len(out[0][0]) % HELD
    return _once(out)


def nearest(home: np.ndarray, home_ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, threshold: float, inner: bool = True, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, id, cosine): of each home vector the ``k`` most similar others, ties by id, above the threshold; ``inner``: home vectors are compared with one another as well."""
    everything, all_ids = (np.concatenate([home, other]), np.concatenate([home_ids, other_ids])) if inner else (other, other_ids)
    right = np.ascontiguousarray(everything.astype(np.float32).T)
    for i in range(0, len(home), 256):
        s = home[i : i + 256].astype(np.float32) @ right
        n = len(s)
        if inner:
            s[np.arange(n), np.arange(i, i + n)] = -2
        limit = np.full(n, threshold - SLACK, np.float32)
        full = np.flatnonzero((s >= threshold - SLACK).sum(1) > k)
        if len(full):
            limit[full] = np.maximum(np.partition(s[full], s.shape[1] - k, axis=1)[:, -k] - SLACK, limit[full])
        r, c = np.nonzero(s >= limit[:, None])
        if not len(r):
            continue
        exact = np.concatenate([np.einsum("ij,ij->i", home[r[p : p + 65536] + i], everything[c[p : p + 65536]]) for p in range(0, len(r), 65536)])
        exact = np.round(exact, DIGITS)
        x, y = home_ids[r + i], all_ids[c]
        order = np.lexsort((y, -exact, r))
        r, x, y, exact = r[order], x[order], y[order], exact[order]
        begin = np.searchsorted(r, r)
        keep = (np.arange(len(r)) - begin < k) & (exact >= threshold)
        yield x[keep], y[keep], exact[keep]


def above(left: np.ndarray, right: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, 32-bit product) of all pairs near or above the threshold; without ``right`` each pair of ``left`` once."""
    a = left.astype(np.float32)
    b = a if right is None else right.astype(np.float32)
    for p in range(0, len(a), 512):
        for q in range(p if right is None else 0, len(b), 2048):
            s = (a[p : p + 512] @ b[q : q + 2048].T).ravel()
            at = np.flatnonzero(s >= threshold - SLACK)
            if len(at):
                r, c = np.divmod(at, min(2048, len(b) - q))
                r, c, s = r + p, c + q, s[at]
                if right is None:
                    once = c > r
                    r, c, s = r[once], c[once], s[once]
                yield r, c, s


def nearest_of_all(x: np.ndarray, ids: np.ndarray, n: int, limit: np.ndarray, threshold: float, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, id, cosine): of each row the ``k`` most similar of the other group, if not less similar than the row's ``limit``.

    The first ``n`` rows are one group, the others the second; where there is no
    second one, rows are compared with their own group.
    """
    limit, shift = limit.copy(), 0 if n == len(x) else n
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, w = (np.concatenate(c) for c in zip(*kept, strict=True))
        order = np.lexsort((ids[j], -w, i))
        i, j, w = i[order], j[order], w[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        limit[i[rank == k - 1]] = np.maximum(limit[i[rank == k - 1]], w[rank == k - 1])
        return i[rank < k], j[rank < k], w[rank < k]

    held = 0
    for i, j, s in above(x[:n], x[n:] if shift else None, threshold):
        j = j + shift
        near = s >= np.minimum(limit[i], limit[j]) - SLACK
        i, j = i[near], j[near]
        w = np.round(np.concatenate([np.einsum("ij,ij->i", x[i[p : p + 65536]], x[j[p : p + 65536]]) for p in range(0, max(len(i), 1), 65536)]), DIGITS)
        for a, b in ((i, j), (j, i)):
            # limits come from products of the same rows, which may be rounded otherwise
            keep = (w >= limit[a] - 1e-12) & (w >= threshold)
            kept.append((a[keep], b[keep], w[keep]))
            held += int(keep.sum())
        if held > HELD:
            kept = [best()]
            held = len(kept[0][0]) // 2
    if kept:
        i, j, w = best()
        yield ids[i], ids[j], w


def merge_links(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster label of each of ``n`` nodes and the links used, by reciprocal nearest neighbours.

    Each round every cluster points to its best link (ties: the earlier link); the
    chain of best links from any cluster ends in a mutual best pair, and under
    single linkage the whole chain may merge at once. Rounds end when no link
    between clusters is left.
    """
    order = np.argsort(-w, kind="stable")
    i, j, link = i[order], j[order], order
    label, used = np.arange(n), []
    while len(i):
        a, b = label[i], label[j]
        cross = a != b
        i, j, link, a, b = i[cross], j[cross], link[cross], a[cross], b[cross]
        if not len(i):
            break
        best = np.full(n, len(i))
        np.minimum.at(best, a, np.arange(len(i)))
        np.minimum.at(best, b, np.arange(len(i)))
        own = np.flatnonzero(best < len(i))
        picked = best[own]
        used.append(link[np.unique(picked)])
        to = np.where(a[picked] == own, b[picked], a[picked])
        point = np.arange(n)
        point[own] = to
        # a mutual pair would point in circles: its smaller member stays
        mutual = own[point[to] == own]
        mutual = mutual[mutual < point[mutual]]
        point[mutual] = mutual
        while (point != point[point]).any():
            point = point[point]
        label = point[label]
    return label, np.concatenate(used) if used else np.zeros(0, np.int64)


def linked(home: np.ndarray, home_ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, threshold: float, inner: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, root, 1): the cluster of each row of a block that is not its smallest id, named by that id."""
    everything, all_ids = np.concatenate([home, other]), np.concatenate([home_ids, other_ids])
    right = np.ascontiguousarray(everything.astype(np.float32).T)
    n, links = len(everything), []
    label = np.arange(n)
    for i in range(0, len(home), 256):
        s = home[i : i + 256].astype(np.float32) @ right
        r, c = np.nonzero(s >= threshold - SLACK)
        away = (c > r + i) & (label[r + i] != label[c])
        r, c = r[away] + i, c[away]
        w = s[r - i, c]
        near = np.flatnonzero(w < threshold + SLACK)
        if len(near):
            exact = np.einsum("ij,ij->i", home[r[near]], everything[c[near]])
            drop = near[exact < threshold]
            w[drop] = -1
            r, c, w = r[w > 0], c[w > 0], w[w > 0]
        if not len(r):
            continue
        _, used = merge_links(n, r, c, w)
        links.append((r[used], c[used], w[used]))
        if sum(len(x[0]) for x in links) > 4 * n or i + 256 >= len(home) or len(links) % 4 == 0:
            p, q, v = (np.concatenate(x) for x in zip(*links, strict=True))
            label, used = merge_links(n, p, q, v)
            links = [(p[used], q[used], v[used])]
    if not links:
        return
    p, q, v = (np.concatenate(x) for x in zip(*links, strict=True))
    label, _ = merge_links(n, p, q, v)
    root = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(root, label, all_ids)
    root = root[label]
    apart = root != all_ids
    yield all_ids[apart], root[apart], np.ones(int(apart.sum()))


def _sample(df: DataFrame, columns: list[str], rows: int) -> list[np.ndarray]:
    fraction = min(1.0, SAMPLE * 1.05 / max(rows, 1))
    got = df.select(*columns).sample(fraction=fraction, seed=11).limit(SAMPLE).toArrow()
    out = []
    for c in columns:
        _, m = matrix(got[c])
        out.append(unit(m) if len(m) else np.zeros((0, 1)))
    return out


def unlinked(x: np.ndarray, ids: np.ndarray, n: int, root: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(root, root, 1): links between rows of different roots that join all roots which rows of the two groups link.

    Groups as in ``nearest_of_all``.
    """
    shift = 0 if n == len(x) else n
    names, node = np.unique(root, return_inverse=True)
    label, used = np.arange(len(names)), []
    for i, j, s in above(x[:n], x[n:] if shift else None, threshold):
        j = j + shift
        apart = label[node[i]] != label[node[j]]
        i, j, s = i[apart], j[apart], s[apart]
        near = np.flatnonzero(s < threshold + SLACK)
        drop = near[np.einsum("ij,ij->i", x[i[near]], x[j[near]]) < threshold]
        i, j = np.delete(i, drop), np.delete(j, drop)
        if len(i):
            a, b = node[i], node[j]
            to, tree = merge_links(len(names), label[a], label[b], np.ones(len(a)))
            label = to[label]
            used.append((a[tree], b[tree]))
    if used:
        a, b = (np.concatenate(c) for c in zip(*used, strict=True))
        yield names[a], names[b], np.ones(len(a))


@dataclass
class Search:
    """What the index found, and what is needed to compare everything."""

    found: DataFrame  # feat, id_a, id_b, w
    copies: DataFrame  # feat, id_a, id_b, w of equal vectors that stay out of all comparisons; they are in found, too
    slim: DataFrame  # id, v0, v1, ...
    rows: int
    dims: list[int | None]
    split: bool  # whether blocks are split, so that a row's best come from several tasks


def compare_all(s: Search, state: DataFrame, kind: str, in_pair: Callable) -> DataFrame:
    """``feat, id_a, id_b, w``: what ``in_pair`` finds in each two groups of rows, which together hold every two rows.

    ``state`` (feat, id, state) says what is known of a vector, ``kind`` is its
    type. ``in_pair`` gets the vectors of two groups, their ids, how many are of the
    first group, their states and which of these are known.
    """
    groups, dims = max(1, -(-s.rows // GROUP)), s.dims
    told = state.select("feat", "id", F.col("state").cast(kind).alias("state"), F.lit(False).alias("out"))
    told = told.unionByName(s.copies.select("feat", F.col("id_a").alias("id"), F.lit(None).cast(kind).alias("state"), F.lit(True).alias("out")).distinct())
    each = [s.slim.select(F.lit(f).alias("feat"), "id", F.lit(None).cast(kind).alias("state"), F.lit(False).alias("out"), F.col(f"v{f}").alias("vec")) for f, d in enumerate(dims) if d]
    rows = reduce(DataFrame.unionByName, each, told.withColumn("vec", F.lit(None).cast("array<float>")))
    own = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    placed = rows.withColumn("g", own).withColumn("h", other).select((F.col("feat") * groups * groups + F.least("g", "h") * groups + F.greatest("g", "h")).alias("pair"), (F.col("g") <= F.col("h")).alias("left"), "id", "state", "out", "vec")
    # few keys of equal weight: with many more partitions than keys hardly two share one
    parts = min(4 * len(dims) * groups * (groups + 1), 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            f = t["pair"][0].as_py() // (groups * groups)
            ids, left, out = t["id"].to_numpy(), np.asarray(t["left"]), np.asarray(t["out"])
            at, m = matrix(t["vec"], dims[f])
            known = np.asarray(t["vec"].is_null()) & ~out & np.asarray(t["state"].is_valid())
            at_in = ~np.isin(ids[at], ids[out])
            at, m = at[at_in], m[at_in]
            order = np.argsort(~left[at], kind="stable")
            at, m = at[order], m[order]
            if not len(at):
                continue
            known_ids, states = ids[known], t["state"].filter(pa.array(known)).to_numpy()
            sort = np.argsort(known_ids)
            known_ids, states = known_ids[sort], states[sort]
            to = np.searchsorted(known_ids, ids[at])
            has = np.zeros(len(at), bool)
            inside = to < len(known_ids)
            has[inside] = known_ids[to[inside]] == ids[at][inside]
            of = np.zeros(len(at), states.dtype)
            of[has] = states[to[has]]
            n = int(left[at].sum())
            # a pair of one group with itself has left rows only; of two groups one may be empty
            if n == 0 or (n == len(at) and t["pair"][0].as_py() % (groups * groups) % (groups + 1)):
                continue
            for x, y, w in in_pair(unit(m), ids[at], n, of, has):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), f, np.int32)), pa.array(x), pa.array(y), pa.array(w)], names=["feat", "id_a", "id_b", "w"])

    return placed.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(run, "feat int, id_a long, id_b long, w double")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, by which they are sorted."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        block = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
        for p, q in zip(edges, edges[1:]):
            if q > p:
                if kept and kept[0].column(0)[0].as_py() != block[p]:
                    yield pa.Table.from_batches(kept)
                    kept = []
                kept.append(b.slice(p, q - p))
    if kept:
        yield pa.Table.from_batches(kept)


def search(df: DataFrame, key: str, columns: list[str], threshold: float, in_block: Callable, k: int = K, miss: float = MISS, sigmas: float = SIGMAS, code: int = CODE) -> Search:
    """``feat, id_a, id_b, w``: what ``in_block`` finds in the blocks of each vector column; ``feat`` is its place in ``columns``.

    Vectors that are null, all zero, not finite, or not of their column's usual
    length take no part, nor do rows with a null key. Keys must be distinct. Of more
    than ``COPIES`` equal vectors the ``k + 1`` with the smallest keys are searched
    for; any other is exactly as similar to those, and its first ``k`` are returned.
    """
    spark = df.sparkSession
    slim = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), *[F.col(f"`{c}`").cast("array<float>").alias(f"v{i}") for i, c in enumerate(columns)])
    rows = slim.count()
    models = [fit(s, rows, threshold, miss, code) if len(s) else None for s in _sample(slim, [f"v{i}" for i in range(len(columns))], rows)]
    # bounded: MAX_BLOCKS centres, a few square matrices and fewer split values than rows of the sample for each substring
    shared = spark.sparkContext.broadcast(models)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most, held, blocks_per_column = radius(threshold, sigmas, code), HELD, MAX_BLOCKS
    columns_of_index = ["bucket", "id", "home", *(f"w{i}" for i in range(code))]

    def usable(b: pa.RecordBatch) -> Iterator[tuple[int, Model, np.ndarray, np.ndarray, np.ndarray]]:
        for f, model in enumerate(shared.value):
            if model is not None:
                at, m = matrix(b.column(1 + f), model.dim)
                if len(at):
                    yield f, model, at, b.column(0).to_numpy()[at], m

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, model, _, ids, m in usable(b):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in index_rows(f, model, ids, unit(m))], names=columns_of_index)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, model, at, ids, m in usable(b):
                home, _ = place(model, unit(m))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f, np.int32)), pa.array(ids), pa.array((home + f * blocks_per_column).astype(np.int32)), b.column(1 + f).take(pa.array(at))], names=["feat", "id", "home", "vec"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def met(now: list[np.ndarray]) -> pa.RecordBatch:
            x, y = compare(now[0], now[1], now[2], [w.view(np.uint64) for w in now[3:]], most)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y.astype(np.int32))], names=["id", "block"])

        for b in batches:
            now = [c.to_numpy() for c in b.columns]
            if kept is not None:
                now = [np.concatenate(p) for p in zip(kept, now, strict=True)]
            # the last bucket may go on in the next batch
            tail = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if tail and len(now[0]) > held // 20:
                yield met([x[:tail] for x in now])
                now = [x[tail:].copy() for x in now]
            kept = now
        if kept is not None and len(kept[0]):
            yield met(kept)

    # one index row per vector and substring
    index = slim.mapInArrow(codes, "bucket long, id long, home int, " + ", ".join(f"w{i} long" for i in range(code)))
    found = index.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(probe, "id long, block int")
    feat = F.floor(F.col("block") / MAX_BLOCKS).cast("int").alias("feat")
    foreign = found.groupBy(feat, "id").agg(F.collect_set("block").alias("foreign"))

    # more equal vectors than COPIES: all but the first k + 1 stay out of the blocks
    def sound(v: str):  # noqa: ANN202
        return F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    hashed = reduce(DataFrame.unionByName, [slim.where(sound(f"v{i}")).select(F.lit(i).alias("feat"), "id", F.xxhash64(f"v{i}").alias("vh")) for i in range(len(columns))])
    crowds = hashed.groupBy("feat", "vh").agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select("feat", "vh")
    crowd = hashed.join(crowds, ["feat", "vh"])
    first = Window.partitionBy("feat", "vh").orderBy("id")
    heads = crowd.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    rest = crowd.join(heads.select("feat", "id"), ["feat", "id"], "left_anti")

    vectors = slim.mapInArrow(homes, "feat int, id long, home int, vec array<float>")
    sent = vectors.join(foreign.unionByName(rest.select("feat", "id", F.array(F.lit(-1)).alias("foreign"))), ["feat", "id"], "left")
    sent = sent.where(F.col("foreign").isNull() | ~F.array_contains("foreign", -1))
    targets = F.concat(F.array(F.struct(F.col("home").alias("block"), F.lit(True).alias("own"))), F.transform(F.coalesce("foreign", F.array().cast("array<int>")), lambda t: F.struct(t.alias("block"), F.lit(False).alias("own"))))
    sent = sent.select("id", "vec", F.explode(targets).alias("t")).select("t.block", "t.own", "id", "vec")

    split = any(m is not None and (m.cells > 1).any() for m in models)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In a split block queries of cell i meet all rows of cell j in the task (i, j); a row that is both there comes once, as a query."""
        for b in batches:
            block, own, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            n = np.ones(len(block), np.int64)
            for f, model in enumerate(shared.value):
                here = block // blocks_per_column == f
                if model is not None:
                    n[here] = model.cells[block[here] % blocks_per_column]
            cell = (mix(ids.view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
            at, query, task = [], [], []
            for many in np.unique(n):
                rows = np.flatnonzero(n == many)
                for k in range(many):
                    at.append(rows)
                    task.append(k * many + cell[rows])
                    query.append(own[rows] & (cell[rows] == k))
                    asks = rows[own[rows] & (cell[rows] != k)]
                    at.append(asks)
                    task.append(cell[asks] * many + k)
                    query.append(np.ones(len(asks), bool))
            at, query, task = np.concatenate(at), np.concatenate(query), np.concatenate(task)
            yield pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int64) * (1 << 32) + task), pa.array(query), pa.array(ids[at]), b.column(3).take(pa.array(at))], names=["block", "own", "id", "vec"])

    placed = sent.mapInArrow(to_cells, "block long, own boolean, id long, vec array<float>") if split else sent.select((F.col("block").cast("long") * (1 << 32)).alias("block"), "own", "id", "vec")
    blocks = placed.repartition(parts, "block").sortWithinPartitions("block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            block, task = divmod(t["block"][0].as_py(), 1 << 32)
            f, at = divmod(block, blocks_per_column)
            # off the diagonal of a split block queries have met one another elsewhere
            inner = task % (int(shared.value[f].cells[at]) + 1) == 0
            m = unit(matrix(t["vec"], shared.value[f].dim)[1])
            ids, home = t["id"].to_numpy(), t["own"].to_numpy()
            for x, y, w in in_block(m[home], ids[home], m[~home], ids[~home], threshold, inner):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), f, np.int32)), pa.array(x), pa.array(y), pa.array(w)], names=["feat", "id_a", "id_b", "w"])

    result = blocks.mapInArrow(work, "feat int, id_a long, id_b long, w double")
    near = heads.where(F.col("r") <= k).select("feat", "vh", F.col("id").alias("id_b"))
    copies = rest.join(near, ["feat", "vh"]).select("feat", F.col("id").alias("id_a"), "id_b", F.lit(1.0).alias("w"))
    return Search(result.unionByName(copies), copies, slim, rows, [m.dim if m else None for m in models], split)


def similar_vectors(df: DataFrame, key: str, columns: list[str], threshold: float = 0.85, exact: bool = False) -> DataFrame:
    """``feat, id_a, id_b``: pairs of rows of which one is among the ten most similar of the other, by cosine.

    ``feat`` is the column's name; smaller key first; ties in similarity, rounded to
    ``DIGITS`` decimals, by key. Every row is indexed and searched for; what the index
    may miss is said above. ``exact`` compares all rows, where the index only says
    from which similarity on a pair can count. See ``search`` for the rows that take part.
    """
    s = search(df, key, columns, threshold, nearest)
    best = Window.partitionBy("feat", "id_a").orderBy(F.desc("w"), "id_b")
    if exact:
        # the tenth best of what the index found is at most the tenth best of all
        top = s.found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= K) if s.split else s.found
        tenth = top.groupBy("feat", F.col("id_a").alias("id")).agg(F.count("*").alias("n"), F.min("w").alias("state")).where(F.col("n") >= K)

        def in_pair(x: np.ndarray, ids: np.ndarray, n: int, limit: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            return nearest_of_all(x, ids, n, np.where(known, limit, threshold), threshold)

        got = compare_all(s, tenth, "double", in_pair)
        got = got.withColumn("r", F.row_number().over(best)).where(F.col("r") <= K).select("feat", "id_a", "id_b").unionByName(s.copies.select("feat", "id_a", "id_b"))
    else:
        # a vector is a query of its home block only, so where no block is split its ten are complete
        got = s.found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= K) if s.split else s.found
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("feat") + 1)
    return got.select("feat", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct().select(name.alias("feat"), "id_a", "id_b")
