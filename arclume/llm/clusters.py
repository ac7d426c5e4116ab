"""Clusters of mutually similar vectors.

Blocks of similar vectors are built by the index of ``vectors``. Within a block
clusters grow by reciprocal nearest neighbours on the sparse graph of links above
the threshold (``vectors.merge_links``). Blocks overlap, and what they share joins
their clusters: rounds of stars, each of which a few aggregations and joins make.

That linkage is single: ``vector_clusters`` is defined by chains of links, and
average linkage would part chains that belong together. ``average_linkage`` merges
by the average similarity instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclume.llm.vectors import compare_all, linked, matrix, search, unit, unlinked
from arclume.session import cut

#: A cluster hangs on single links near the threshold, so fewer of them may be missed than in a search of near neighbours.
#: With such a radius, codes must be longer to keep rows that have nothing in common apart.
MISS, SIGMAS, CODE = 1e-3, 4.0, 3
#: Bytes of sums and number of links that one task merges.
FEW_BYTES, FEW_LINKS = 64 << 20, 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node each node of ``edges`` (u, v) is connected with, itself included.

    Large and small stars in turns, each a minimum per node and a join back; a hub's
    neighbours are never gathered. Edges with a null end and loops are left out.
    """
    e = cut(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("x"), F.explode(F.array("u", "v")).alias("y")).where(F.col("x") != F.col("y")).select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
        new = cut(small)
        # done once every node hangs on one root that hangs on nothing
        open_ends = new.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or new.select(F.col("u").alias("v")).join(new.select("v"), "v", "left_semi").limit(1).count()
        e = new
        if not open_ends:
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def vector_clusters(df: DataFrame, key: str, column: str, threshold: float = 0.85, least: int = 3, exact: bool = False) -> DataFrame:
    """``key``, ``first_id``: members of clusters of ``least`` rows or more, with the smallest key of the cluster.

    Rows are linked if their cosine, in double precision, is at least ``threshold``,
    and clustered if linked directly or through others. See ``vectors.search`` for
    the rows that take part; repeated vectors are members like any other. An empty
    table gives no clusters. A link at the threshold is missed with a chance of about
    ``MISS`` and links of greater similarity less; ``exact`` compares all rows of
    different clusters afterwards, which takes time by the square of the rows.
    """
    s = search(df, key, [column], threshold, linked, miss=MISS, sigmas=SIGMAS, code=CODE)
    found = cut(components(s.found.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))))

    if exact:

        def in_pair(x: np.ndarray, ids: np.ndarray, n: int, root: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            return unlinked(x, ids, n, np.where(known, root, ids), threshold)

        missed = cut(compare_all(s, found.select(F.lit(0).alias("feat"), F.col("node").alias("id"), F.col("root").alias("state")), "long", in_pair).select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))
        if not missed.isEmpty():
            found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(missed))
    sizes = found.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("root")
    return found.join(sizes, "root").select(F.col("node").alias(key), F.col("root").alias("first_id"))


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean cosine between the members of two clusters, from the sums of their unit vectors."""
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.asarray(b.column(i).flatten()).reshape(b.num_rows, -1) for i in (3, 5))
        w = np.einsum("ij,ij->i", x, y) / (b.column(2).to_numpy() * b.column(4).to_numpy())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(w, 12))], names=["u", "v", "w"])


def merge_mutual(ids: np.ndarray, n: np.ndarray, sums: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """The cluster of each of ``ids``, named by its smallest one, by the rounds of ``average_linkage``; ``u`` and ``v`` are places in ``ids``."""
    root, n, sums = np.arange(len(ids)), n.copy(), sums.copy()
    w = np.full(len(u), np.nan)
    while len(u):
        new = np.flatnonzero(np.isnan(w))
        for i in range(0, len(new), 65536):
            e = new[i : i + 65536]
            w[e] = np.round(np.einsum("ij,ij->i", sums[u[e]], sums[v[e]]) / (n[u[e]] * n[v[e]]), 12)
        keep = w >= threshold
        u, v, w = u[keep], v[keep], w[keep]
        if not len(u):
            break
        a, b, s = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w])
        order = np.lexsort((ids[b], -s, a))
        first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])]
        best = np.full(len(ids), -1)
        best[a[first]] = b[first]
        one = np.flatnonzero((best >= 0) & (best[np.maximum(best, 0)] == np.arange(len(ids))))
        one = one[ids[one] < ids[best[one]]]
        other = best[one]
        sums[one] += sums[other]
        n[one] += n[other]
        to = np.arange(len(ids))
        to[other] = one
        root = to[root]
        changed = np.zeros(len(ids), bool)
        changed[one] = changed[other] = True
        w[changed[u] | changed[v]] = np.nan
        u, v = np.minimum(to[u], to[v]), np.maximum(to[u], to[v])
        # one link of each two clusters; all copies of a changed one are scored anew
        order = np.lexsort((v, u))
        u, v, w = u[order], v[order], w[order]
        once = (u != v) & np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        u, v, w = u[once], v[once], w[once]
    return ids[root]


def _finish(sums: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """``id, root`` of few clusters (``sums``) and links, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.list_(pa.float64()))]))
        node = np.asarray(t["s"].is_valid())
        if not node.any():
            return
        ids, n = t["a"].to_numpy()[node], t["b"].to_numpy()[node]
        x = np.asarray(t["s"].filter(pa.array(node)).combine_chunks().flatten()).reshape(len(ids), -1)
        order = np.argsort(ids)
        ids, n, x = ids[order], n[order], x[order]
        u, v = (np.minimum(np.searchsorted(ids, t[c].to_numpy()[~node]), len(ids) - 1) for c in "ab")
        there = (ids[u] == t["a"].to_numpy()[~node]) & (ids[v] == t["b"].to_numpy()[~node])
        root = merge_mutual(ids, n, x, u[there], v[there], threshold)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], names=["id", "root"])

    both = sums.select(F.col("id").alias("a"), F.col("n").alias("b"), "s").unionByName(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(None).cast("array<double>").alias("s")))
    return both.coalesce(1).mapInArrow(run, "id long, root long")


def average_linkage(df: DataFrame, key: str, column: str, links: DataFrame, threshold: float = 0.85, least: int = 3) -> DataFrame:
    """``key, first_id``: clusters of ``least`` rows or more by average linkage on the sparse graph of ``links`` (u, v).

    Each round every cluster points to the linked cluster with the greatest mean
    cosine between members, ties to the smaller key; all pairs that point at each
    other merge at once, and rounds end when no mean reaches ``threshold``. Means are
    exact, from sums of unit vectors; only linked clusters are compared. With all
    links at or above the threshold that is plain average linkage: clusters of such
    a mean have a link, and merging mutual best pairs in any order gives the same
    tree. A round moves the sums of clusters that changed and the links at them; what
    is left when clusters and links are counted to be few (``FEW_BYTES``, ``FEW_LINKS``)
    is merged by the same rounds in one task, as a round of jobs would take longer.
    Rows without a link, or whose vectors ``vectors.matrix`` leaves out, are in no cluster.
    """

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m = matrix(b.column(1))
            if len(at):
                x = unit(m)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.ones(len(at), np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["id", "n", "s"])

    edges = cut(links.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("w", F.lit(None).cast("double")))
    ends = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<float>").alias("vec")).join(ends, "id", "left_semi")
    sums = cut(rows.mapInArrow(units, "id long, n long, s array<double>"))
    members = sums.select("id", F.col("id").alias("root"))
    while True:
        count, width = sums.agg(F.count("*"), F.coalesce(F.max(F.size("s")), F.lit(0))).first()
        if count * width * 8 <= FEW_BYTES and edges.count() <= FEW_LINKS:
            last = cut(_finish(sums, edges, threshold)).select(F.col("id").alias("root"), F.col("root").alias("to"))
            members = cut(members.join(last.hint("merge"), "root").select("id", F.col("to").alias("root")))
            break
        # nothing is broadcast: the driver would have to hold every round's tables
        new = edges.where("w is null").join(sums.toDF("u", "n1", "s1").hint("merge"), "u").join(sums.toDF("v", "n2", "s2").hint("merge"), "v").select("u", "v", "n1", "s1", "n2", "s2")
        scored = new.mapInArrow(_means, "u long, v long, w double")
        edges = cut(edges.where("w is not null").unionByName(scored.where(F.col("w") >= threshold)))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        best = both.groupBy("u").agg(F.max_by("v", F.struct("w", -F.col("v"))).alias("v"))
        merged = cut(best.alias("a").join(best.alias("b").hint("merge"), (F.col("a.u") == F.col("b.v")) & (F.col("a.v") == F.col("b.u"))).where("a.u < a.v").select(F.col("a.u").alias("keep"), F.col("a.v").alias("gone")))
        if merged.isEmpty():
            break
        touched = merged.select(F.explode(F.array("keep", "gone")).alias("id"))
        pair = merged.join(sums.toDF("keep", "n1", "s1").hint("merge"), "keep").join(sums.toDF("gone", "n2", "s2").hint("merge"), "gone")
        sums = cut(sums.join(touched.hint("merge"), "id", "left_anti").unionByName(pair.select(F.col("keep").alias("id"), (F.col("n1") + F.col("n2")).alias("n"), F.zip_with("s1", "s2", lambda x, y: x + y).alias("s"))))
        # links at merged clusters are scored anew
        to = merged.select(F.explode(F.array(F.struct(F.col("keep").alias("id"), F.col("keep").alias("to")), F.struct(F.col("gone").alias("id"), F.col("keep").alias("to")))).alias("x")).select("x.id", "x.to")
        moved = edges.join(to.toDF("u", "u2").hint("merge"), "u", "left").join(to.toDF("v", "v2").hint("merge"), "v", "left")
        moved = moved.select(F.coalesce("u2", "u").alias("a"), F.coalesce("v2", "v").alias("b"), F.when(F.col("u2").isNull() & F.col("v2").isNull(), F.col("w")).alias("w"))
        edges = cut(moved.where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max("w").alias("w")))
        members = cut(members.join(merged.select(F.col("gone").alias("root"), "keep").hint("merge"), "root", "left").select("id", F.coalesce("keep", "root").alias("root")))
    sizes = members.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("root")
    return members.join(sizes, "root").select(F.col("id").alias(key), F.col("root").alias("first_id"))


def describe(df: DataFrame, members: DataFrame, key: str, column: str, typical: int = 3) -> DataFrame:
    """``first_id, size, rank, key, typicality``: each cluster's size and its most typical members.

    Typical is what is most similar to the mean direction of the cluster; ties go
    to the smaller key. Means are sums per dimension, aggregated before they are
    shuffled.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").cast("array<double>").alias("v")).join(members, key)
    long = rows.select("first_id", F.posexplode("v").alias("d", "x"), norm(F.col("v")).alias("n"))
    mean = long.groupBy("first_id", "d").agg(F.sum(F.col("x") / F.col("n")).alias("m"), F.count("*").alias("size"))
    centre = mean.groupBy("first_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centre"), F.max("size").alias("size"))
    dot = F.aggregate(F.zip_with("v", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = rows.join(centre, "first_id").select("first_id", "size", key, F.round(dot / (norm(F.col("v")) * norm(F.col("centre"))), 6).alias("typicality"))
    rank = F.row_number().over(Window.partitionBy("first_id").orderBy(F.desc("typicality"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= typical).select("first_id", "size", "rank", key, "typicality")
