"""Queries of the sphere: geometry, prototypes, context, metrics. Clips are the rows of ``embeddings``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclume.functions.arrays import gather_or_zeros, last_vision_state, marker_positions, shape_text
from arclume.operators import vector as V
from arclume.operators.context import ambiguity, enhance, guided_pull
from arclume.operators.metrics import ranking_metrics
from arclume.operators.prototypes import kmeans
from arclume.plans.registry import query
from arclume.session import table

UNITS = """v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (select vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) as u from v),
m as (select u as mu from u order by vec_id limit 1)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, u: unit vectors of all clips."""
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", V.row_map(V.normalize)("embedding").alias("u"))


def _pole(df: DataFrame) -> np.ndarray:
    return np.array(df.agg(F.min_by("u", "vec_id")).first()[0])


def label_prototypes(df: DataFrame) -> tuple[list[int], np.ndarray]:
    """Labels and the normalised mean of each; there are as many as labels."""
    sums = df.select("label", F.posexplode("u").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    rows = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("p")).orderBy("label").collect()
    return [r.label for r in rows], V.normalize(np.array([[x.x for x in r.p] for r in rows]))


PROTOTYPES = """pm as (select label, i, avg(u[i]) as x from u, range(1, 65) t(i) group by label, i),
pl as (select label, list(x order by i) as p0 from pm group by label),
p as (select label, list_transform(p0, lambda x: x / sqrt(list_dot_product(p0, p0))) as p from pl)"""


@query(f"with {UNITS} select vec_id, round(sqrt(list_dot_product(e, e)), 6) as norm, round(u[1], 6) as first, round(sqrt(list_dot_product(u, u)), 6) as unit_norm from u join v using (vec_id)")
def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms before and after normalisation."""
    norm = V.row_score(lambda x: np.linalg.norm(x, axis=1))
    raw = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", norm("embedding").alias("n"))
    u = units(spark, sf_dir).select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(norm("u"), 6).alias("unit_norm"))
    return raw.select("vec_id", F.round("n", 6).alias("norm")).join(u, "vec_id")


LOGS = f"""{UNITS},
d as (select vec_id, label, u, mu, greatest(least(list_dot_product(u, mu), 1 - 1e-7), -1 + 1e-7) as d from u, m),
r as (select *, list_transform(range(1, 65), lambda i: u[i] - d * mu[i]) as r from d),
l as (select *, list_transform(r, lambda x: x / greatest(sqrt(list_dot_product(r, r)), 1e-8) * acos(d)) as l from r)"""


@query(f"with {LOGS} select vec_id, round(sqrt(list_dot_product(l, l)), 6) as tangent_norm, round(l[2], 6) as second from l")
def vec_log_map_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the tangent vector from the first clip to each."""
    u = units(spark, sf_dir)
    mu = _pole(u)
    logs = u.select("vec_id", V.row_map(lambda x: V.log_map(x, mu))("u").alias("l"))
    return logs.select("vec_id", F.round(V.row_score(lambda x: np.linalg.norm(x, axis=1))("l"), 6).alias("tangent_norm"), F.round(F.get("l", F.lit(1)), 6).alias("second"))


@query(f"""with {LOGS}, n as (select *, greatest(sqrt(list_dot_product(l, l)), 1e-8) as n from l),
x as (select vec_id, u, list_transform(range(1, 65), lambda i: cos(n) * mu[i] + sin(n) * l[i] / n) as x from n)
select vec_id, round(list_dot_product(u, x) / sqrt(list_dot_product(x, x)), 6) as cosine from x""")
def vec_exp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each clip with the point that its own tangent vector leads to."""
    u = units(spark, sf_dir)
    mu = _pole(u)
    return u.select("vec_id", F.round(V.row_score(lambda x: (x * V.exp_map(V.log_map(x, mu), mu)).sum(1))("u"), 6).alias("cosine"))


@query(f"""with {UNITS}, {PROTOTYPES},
g as (select p.label, vec_id, acos(greatest(least(list_dot_product(u, p), 1 - 1e-7), -1 + 1e-7)) as angle from u, p),
k as (select *, row_number() over (partition by label order by angle, vec_id) as rank from g)
select label, rank::int as rank, vec_id, round(angle, 6) as angle from k where rank <= 5""")
def geodesic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five clips nearest to the mean direction of each label."""
    u = units(spark, sf_dir)
    labels, protos = label_prototypes(u)
    near = u.select("vec_id", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("label"), V.row_map(lambda x: V.geodesic(x, protos))("u").alias("angle"))).alias("z")).select("vec_id", "z.label", "z.angle")
    w = Window.partitionBy("label").orderBy("angle", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("label", "rank", "vec_id", F.round("angle", 6).alias("angle"))


@query(f"""with {LOGS}, t as (select *, acos(d) as t, greatest(sin(acos(d)), 1e-8) as s from d),
x as (select vec_id, mu, list_transform(range(1, 65), lambda i: sin(0.5 * t) / s * u[i] + sin(0.5 * t) / s * mu[i]) as x from t)
select vec_id, round(list_dot_product(x, mu) / sqrt(list_dot_product(x, x)), 6) as cosine, round(x[3] / sqrt(list_dot_product(x, x)), 6) as third from x""")
def slerp_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point half way from each clip to the first one."""
    u = units(spark, sf_dir)
    mu = _pole(u)
    s = u.select("vec_id", V.row_map(lambda x: V.slerp(x, mu, 0.5))("u").alias("s"))
    return s.select("vec_id", F.round(V.row_score(lambda x: x @ mu)("s"), 6).alias("cosine"), F.round(F.get("s", F.lit(2)), 6).alias("third"))


def _frechet_sql(group: str, rounds: int = 5) -> str:
    """CTEs ``f(g, mu)``: the mean of each group, one step after another."""
    steps = [f"s as (select {group} as g, u from u)", "a0 as (select g, i, avg(u[i]) as x from s, range(1, 65) t(i) group by g, i)", "b0 as (select g, list(x order by i) as p from a0 group by g)", "f0 as (select g, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) as mu from b0)"]
    for n in range(1, rounds + 1):
        steps += [
            f"d{n} as (select s.g, u, mu, greatest(least(list_dot_product(u, mu), 1 - 1e-7), -1 + 1e-7) as d from s join f{n - 1} using (g))",
            f"r{n} as (select g, d, list_transform(range(1, 65), lambda i: u[i] - d * mu[i]) as r from d{n})",
            f"l{n} as (select g, list_transform(r, lambda x: x / greatest(sqrt(list_dot_product(r, r)), 1e-8) * acos(d)) as l from r{n})",
            f"a{n} as (select g, i, avg(l[i]) as x from l{n}, range(1, 65) t(i) group by g, i)",
            f"b{n} as (select g, list(x order by i) as a from a{n} group by g)",
            f"t{n} as (select g, mu, a, greatest(sqrt(list_dot_product(a, a)), 1e-8) as t from b{n} join f{n - 1} using (g))",
            f"e{n} as (select g, list_transform(range(1, 65), lambda i: cos(t) * mu[i] + sin(t) * a[i] / t) as x from t{n})",
            f"f{n} as (select g, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) as mu from e{n})",
        ]
    return f"{UNITS}, " + ", ".join(steps) + f", f as (select * from f{rounds})"


@query(f"with {_frechet_sql('0')} select (i - 1)::int as dim, round(mu[i], 5) as x from f, range(1, 65) t(i)")
def frechet_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean direction of all clips."""
    mu = V.frechet_mean(table(spark, sf_dir, "embeddings"), "embedding")
    return spark.createDataFrame([(i, round(float(x), 5)) for i, x in enumerate(mu)], "dim int, x double")


@query(f"with {_frechet_sql('(label >= 5)::int')} select round(degrees(acos(greatest(least(list_dot_product(x.mu, y.mu), 1), -1))), 4) as degrees from f x, f y where x.g = 0 and y.g = 1")
def frechet_gap_deg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle between the mean directions of normal and abnormal clips."""
    e = table(spark, sf_dir, "embeddings")
    gap = V.angle_degrees(V.frechet_mean(e.where("label < 5"), "embedding"), V.frechet_mean(e.where("label >= 5"), "embedding"))
    return spark.createDataFrame([(round(gap, 4),)], "degrees double")


@query(f"with {LOGS}, c as (select vec_id, list_transform(l, lambda x: x / greatest(sqrt(list_dot_product(l, l)), 1e-12)) as c from l) select vec_id, round(c[1], 5) as first, round(c[64], 5) as last from c")
def spherical_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of each clip as seen from the first one."""
    u = units(spark, sf_dir)
    mu = _pole(u)
    c = u.select("vec_id", V.row_map(lambda x: V.normalize(V.log_map(x, mu)))("u").alias("c"))
    return c.select("vec_id", F.round(F.get("c", F.lit(0)), 5).alias("first"), F.round(F.element_at("c", -1), 5).alias("last"))


SCORES = f"""{UNITS}, {PROTOTYPES},
b as (select vec_id, u.label, -(1 / 0.3) * acos(greatest(least(max(list_dot_product(u, p)) filter (p.label < 5), 1 - 1e-7), -1 + 1e-7)) as ln,
  -(1 / 0.3) * acos(greatest(least(max(list_dot_product(u, p)) filter (p.label >= 5), 1 - 1e-7), -1 + 1e-7)) as la from u, p group by vec_id, u.label),
sc as (select vec_id, label, exp(la - greatest(ln, la)) / (exp(ln - greatest(ln, la)) + exp(la - greatest(ln, la)) + 1e-8) as score from b)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, u, score by the label prototypes."""
    u = units(spark, sf_dir)
    labels, protos = label_prototypes(u)
    abnormal = np.array(labels) >= 5
    return u.withColumn("score", V.row_score(lambda x: V.vmf(x, protos[~abnormal], protos[abnormal]))("u"))


@query(f"with {SCORES} select vec_id, round(score, 6) as score from sc")
def vmf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each clip to be abnormal."""
    return scored(spark, sf_dir).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""with {SCORES}, vs as (select vec_id // 10 as video_id, max(score) as p, max((label >= 5)::int) as label from sc group by 1),
g as (select p, sum(label) as tp, sum(1 - label) as fp from vs group by p),
c as (select p, tp, fp, sum(tp) over (order by p desc) as ctp, sum(tp) over () as np, sum(fp) over () as nn from g)
select round(case when max(np) > 0 and max(nn) > 0 then sum(fp / nn * (ctp - tp / 2) / np) end, 6) as auc from c""")
def video_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC-AUC of the highest clip score of each video."""
    s = scored(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 10).alias("video_id")).agg(F.max("score").alias("p"), F.max((F.col("label") >= 5).cast("int")).alias("label"))
    return ranking_metrics(s, [], "p", "label").select(F.round("auc", 6).alias("auc"))


@query("select event_id, round(1 / (1 + exp(length(event_type) / 10.0 - value)), 6) as p_yes from events where value is not null")
def zero_shot_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first of two logits."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", F.round(1 / (1 + F.exp(F.length("event_type") / F.lit(10.0) - F.col("value"))), 6).alias("p_yes"))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("e", i * 8 + 1, 8)).alias("layers"))


@query("""with l as (select vec_id, i, list_transform(embedding, lambda x: x::double)[i * 8 + 1 : i * 8 + 8] as s from embeddings, (values (0), (3), (7), (8), (31)) t(i))
select vec_id, i as layer, round(coalesce(list_sum(s), 0), 6) as total from l""")
def layer_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted layers of each clip; those that are not there are zeros."""
    wanted = [0, 3, 7, 8, 31]
    got = _layers(spark, sf_dir).select("vec_id", F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in wanted]).alias("layer"), gather_or_zeros(F.col("layers"), wanted, 8).alias("s"))).alias("z"))
    return got.select("vec_id", "z.layer", F.round(F.aggregate("z.s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""select vec_id, round(list_transform(embedding, lambda x: x::double)[(case when label <= 7 then label else 7 end) * 8 + 1], 6) as first, '[8, 8]' as shape from embeddings""")
def last_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at a position, or the last one where there is none."""
    got = _layers(spark, sf_dir)
    state = last_vision_state(F.col("layers"), F.col("label").cast("int"))
    return got.select("vec_id", F.round(F.get(state, F.lit(0)), 6).alias("first"), shape_text(F.array(F.size("layers"), F.size(F.get("layers", F.lit(0))))).alias("shape"))


@query("""with o as (select l_orderkey, list((l_quantity::int % 4) order by l_linenumber, l_quantity::int % 4) as ids from lineitem group by l_orderkey),
p as (select *, list_filter(range(0, len(ids)), lambda i: ids[i + 1] = 1) as s, list_filter(range(0, len(ids)), lambda i: ids[i + 1] = 2) as e from o)
select l_orderkey, case when len(s) >= 1 and len(e) >= 1 then array_to_string(range(s[1] + 1, e[1]), ',') end as positions from p""")
def marker_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions between the first start and the first end marker of each sequence."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.pmod(F.col("l_quantity").cast("int"), F.lit(4)).alias("t")))).alias("a"))
    ids = F.transform("a", lambda x: x["t"])
    return lines.select("l_orderkey", F.array_join(marker_positions(ids, 1, 2, 1), ",").alias("positions"))


@query()
def spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five prototypes of the abnormal clips (own definition)."""
    c = kmeans(table(spark, sf_dir, "embeddings").where("label >= 5"), "vec_id", "embedding", 5, 20)
    return spark.createDataFrame([(k, d, round(float(x), 4)) for k, row in enumerate(c) for d, x in enumerate(row)], "k int, dim int, x double")


@query()
def kmeans_cosine_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's k-means by cosine, for comparison with the own one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=5, seed=42, distanceMeasure="cosine", maxIter=20).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


@query("with c as (select median(l_discount) as c, mad(l_discount) as r from lineitem) select round(greatest(0, c - r), 6) as low, round(least(1, c + r), 6) as high from c")
def mad_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ambiguity interval of a score (own definition)."""
    low, high = ambiguity(table(spark, sf_dir, "lineitem"), "l_discount")
    return spark.createDataFrame([(round(low, 6), round(high, 6))], "low double, high double")


@query("with c as (select greatest(0, median(l_discount) - mad(l_discount)) as lo, least(1, median(l_discount) + mad(l_discount)) as hi from lineitem) select l_returnflag, count(*) filter (l_discount between lo and hi) as ambiguous, count(*) filter (l_discount > hi) as above from lineitem, c group by l_returnflag")
def ambiguous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many scores of each kind lie in the ambiguity interval and above it."""
    t = table(spark, sf_dir, "lineitem")
    low, high = ambiguity(t, "l_discount")
    x = F.col("l_discount")
    return t.groupBy("l_returnflag").agg(F.count_if(x.between(low, high)).alias("ambiguous"), F.count_if(x > high).alias("above"))


@query(f"""with {UNITS}, h as (select vec_id, u, list_reverse(u) as h from u),
n as (select a.vec_id, b.vec_id as other, list_dot_product(a.h, b.h) as s, b.u as bu from h a join h b on a.vec_id <> b.vec_id where list_dot_product(a.h, b.h) >= 0.2),
k as (select *, row_number() over (partition by vec_id order by s desc, other) as rank from n),
w as (select vec_id, i, sum(s * bu[i]) / sum(s) as x from k, range(1, 65) t(i) where rank <= 10 group by vec_id, i),
a as (select vec_id, list(x order by i) as a from w group by vec_id),
x as (select vec_id, case when a is null then u else list_transform(range(1, 65), lambda i: 0.65 * u[i] + 0.35 * a[i]) end as x from u left join a using (vec_id))
select vec_id, round(x[1] / sqrt(list_dot_product(x, x)), 5) as first, round(x[64] / sqrt(list_dot_product(x, x)), 5) as last from x""")
def holistic_enhance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips mixed with their neighbours by the reversed vector (own definition)."""
    u = units(spark, sf_dir).withColumn("h", F.reverse("u"))
    got = enhance(u, "vec_id", "u", "h", 0.35, 0.2, 10)
    return got.select("vec_id", F.round(F.get("enhanced", F.lit(0)), 5).alias("first"), F.round(F.element_at("enhanced", -1), 5).alias("last"))


@query()
def guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous clips drawn towards their video's dominant prototypes (own definition)."""
    s = scored(spark, sf_dir).withColumn("video_id", F.floor(F.col("vec_id") / 10))
    labels, protos = label_prototypes(units(spark, sf_dir))
    abnormal = np.array(labels) >= 5
    low, high = ambiguity(s, "score")
    got = guided_pull(s, "video_id", "vec_id", "u", "score", protos[~abnormal], protos[abnormal], low, high, 0.3)
    return got.select("vec_id", "video_id", "is_abnormal", F.round(F.get("pulled", F.lit(0)), 5).alias("first"))


METHODS = """sc as (select 'M1' as method, o_totalprice as p, (o_orderpriority like '1%')::int as label from orders where o_totalprice is not null and o_orderpriority is not null
union all select 'M2', -o_totalprice, (o_orderpriority like '1%')::int from orders where o_totalprice is not null and o_orderpriority is not null
union all select 'M3', (o_custkey % 97)::double, (o_orderpriority like '1%')::int from orders where o_custkey is not null and o_orderpriority is not null),
g as (select method, p, sum(label)::double as tp, sum(1 - label)::double as fp from sc group by method, p),
c as (select method, p, tp, fp, sum(tp) over (partition by method order by p desc) as ctp, sum(fp) over (partition by method order by p desc) as cfp, sum(tp) over (partition by method) as np, sum(fp) over (partition by method) as nn from g),
a as (select method, sum(tp / np * ctp / (ctp + cfp)) as ap, sum(fp / nn * (ctp - tp / 2) / np) as auc from c group by method)"""


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("label", F.startswith("o_orderpriority", F.lit("1")).cast("int"))
    each = F.array(F.struct(F.lit("M1").alias("method"), F.col("o_totalprice").alias("p")), F.struct(F.lit("M2").alias("method"), (-F.col("o_totalprice")).alias("p")), F.struct(F.lit("M3").alias("method"), F.pmod("o_custkey", F.lit(97)).cast("double").alias("p")))
    return ranking_metrics(o.select("label", F.explode(each).alias("z")).select("z.method", "z.p", "label"), ["method"], "p", "label")


@query(f"with {METHODS} select method, round(ap, 6) as ap from a")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of three scores of the orders."""
    return _methods(spark, sf_dir).select("method", F.round("ap", 6).alias("ap"))


@query(f"with {METHODS} select method, round(auc, 6) as auc from a")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve of three scores of the orders."""
    return _methods(spark, sf_dir).select("method", F.round("auc", 6).alias("auc"))


@query(f"with {METHODS} select method, round(ap, 6) as ap from a order by ap desc, method limit 1")
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method with the highest average precision; of equals the first."""
    return _methods(spark, sf_dir).orderBy(F.desc("ap"), "method").limit(1).select("method", F.round("ap", 6).alias("ap"))


@query(f"with {METHODS} select method, round(ap - (select ap from a where method = 'M1'), 6) as d_ap, round(auc - (select auc from a where method = 'M1'), 6) as d_auc from a")
def delta_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of each method from the first."""
    m = _methods(spark, sf_dir)
    base = m.where("method = 'M1'").select(F.col("ap").alias("b_ap"), F.col("auc").alias("b_auc"))
    return m.join(F.broadcast(base)).select("method", F.round(F.col("ap") - F.col("b_ap"), 6).alias("d_ap"), F.round(F.col("auc") - F.col("b_auc"), 6).alias("d_auc"))
