"""Distances, clustering, evaluation and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, distance, features, stats
from . import fixtures as fx
from .registry import query, r6, round_doubles

WEEK_COLS = [f"w{w}" for w in fx.WEEKS]
VARS = [*fx.SENSORS, *fx.DENSE]


def _week_matrix(spark, folder, value="all_mean"):
    """Weekly means to ten decimals: the last digits of a mean depend on the order of its readings, and equal subjects are equal points."""
    matrix = features.trajectory_matrix(fx.sensor_day(spark, folder), value, fx.WEEKS)
    return matrix.withColumns({c: F.round(c, 10) for c in WEEK_COLS})


def trajectories(spark, folder, value="all_mean"):
    return distance.with_vector(_week_matrix(spark, folder, value), WEEK_COLS)


def vectors(spark, folder):
    return fx.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


_W = ", ".join(f"avg(all_mean) FILTER (week = {w}) AS w{w}" for w in fx.WEEKS)
_MATRIX = f"wm AS (SELECT * FROM (SELECT num_id, {_W} FROM sensor_day GROUP BY num_id) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in WEEK_COLS) + ")"
_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_PAIR = "d AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.label AS la, b.label AS lb, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id < b.vec_id)"


@query("ds_euclid", fx.with_views(_VEC, _PAIR) + "SELECT id_a, id_b, round(dist, 6) AS dist FROM d")
def ds_euclid(spark, folder):
    return round_doubles(distance.distance_edges(vectors(spark, folder), "vec_id", "vec"))


@query(
    "ds_stats",
    fx.with_views(_VEC, _PAIR)
    + 'SELECT 0.0::DOUBLE AS "min", round(max(dist), 6) AS "max", round(2 * sum(dist) / ((SELECT count(*) FROM v) ** 2), 6) AS mean FROM d',
)
def ds_stats(spark, folder):
    points = vectors(spark, folder)
    return round_doubles(distance.distance_stats(points, "vec_id", "vec"))


def _dtw_sql():
    t = len(WEEK_COLS)
    steps = ["p AS (SELECT a.num_id AS id_a, b.num_id AS id_b, " + ", ".join(f"abs(a.w{i} - b.w{j}) AS c{i}{j}" for i in range(t) for j in range(t)) + " FROM wm a JOIN wm b ON a.num_id < b.num_id)"]
    last = "p"
    for i in range(t):
        for j in range(t):
            before = [f"s{x}{y}" for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            cell = f"c{i}{j}" + (f" + least({', '.join(before)})" if before else "")
            steps.append(f"q{i}{j} AS (SELECT *, {cell} AS s{i}{j} FROM {last})")
            last = f"q{i}{j}"
    return steps, f"SELECT id_a, id_b, s{t - 1}{t - 1} AS dist FROM {last}"


_DTW_STEPS, _DTW_LAST = _dtw_sql()
_DTW = [fx.SENSOR_DAY, _MATRIX, *_DTW_STEPS, f"dtw AS ({_DTW_LAST})"]


@query("ds_dtw", fx.with_views(*_DTW) + "SELECT id_a, id_b, round(dist, 6) AS dist FROM dtw")
def ds_dtw(spark, folder):
    return round_doubles(distance.distance_edges(trajectories(spark, folder), "num_id", "vec", "dtw"))


@query(
    "jn_self_pair",
    "WITH m AS (SELECT user_id AS num_id, avg(value) AS m FROM events GROUP BY 1) SELECT a.num_id AS id_a, b.num_id AS id_b, round(abs(a.m - b.m), 6) AS dist FROM m a JOIN m b ON a.num_id < b.num_id",
)
def jn_self_pair(spark, folder):
    means = fx.table(spark, folder, "events").groupBy(F.col("user_id").alias("num_id")).agg(F.avg("value").alias("m"))
    return round_doubles(distance.distance_edges(distance.with_vector(means, ["m"]), "num_id", "vec"))


@query(
    "cl_silhouette",
    fx.with_views(
        _VEC, _PAIR,
        "s AS (SELECT id_a AS id, la AS own, lb AS other, dist FROM d UNION ALL SELECT id_b, lb, la, dist FROM d)",
        "sz AS (SELECT label, count(*) AS n FROM v GROUP BY 1)",
        "t AS (SELECT id, own, other, sum(dist) AS total FROM s GROUP BY 1, 2, 3)",
        "ab AS (SELECT id, max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM t JOIN sz ON other = label GROUP BY 1)",
    )
    + "SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) + 0.0 AS silhouette FROM ab",
)
def cl_silhouette(spark, folder):
    return round_doubles(distance.silhouette(vectors(spark, folder), "vec_id", "vec", "label"))


@query(
    "cl_db",
    fx.with_views(
        _VEC,
        "x AS (SELECT vec_id, label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v)",
        "c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY 1, 2)",
        "ds AS (SELECT vec_id, x.label, sqrt(sum((x - c) ** 2)) AS d FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY 1, 2)",
        "s AS (SELECT label, avg(d) AS s FROM ds GROUP BY 1)",
        "m AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.c - b.c) ** 2)) AS m FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2)",
        "r AS (SELECT la, max((sa.s + sb.s) / m) AS r FROM m JOIN s sa ON la = sa.label JOIN s sb ON lb = sb.label GROUP BY 1)",
    )
    + "SELECT round(avg(r), 6) AS davies_bouldin FROM r",
)
def cl_db(spark, folder):
    return round_doubles(distance.davies_bouldin(vectors(spark, folder), "vec", "label", 64))


_EPS = [6.0, 10.0, 16.0]
_MIN = 5


_DBSCAN_SQL = (
    fx.with_views(
        *_DTW,
        f"eps AS (SELECT unnest({_EPS}) AS eps)",
        "nb AS (SELECT eps, id_a AS a, id_b AS b FROM dtw, eps WHERE dist <= eps UNION ALL SELECT eps, id_b, id_a FROM dtw, eps WHERE dist <= eps)",
        f"core AS (SELECT eps, a AS num_id FROM nb GROUP BY 1, 2 HAVING count(*) + 1 >= {_MIN})",
        "cc AS (SELECT nb.eps, a, b FROM nb JOIN core x ON x.eps = nb.eps AND x.num_id = a JOIN core y ON y.eps = nb.eps AND y.num_id = b)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, walk AS (SELECT eps, num_id AS a, num_id AS b FROM core UNION SELECT w.eps, w.a, c.b FROM walk w JOIN cc c ON c.eps = w.eps AND c.a = w.b),
    comp AS (SELECT eps, a AS num_id, min(b) AS c FROM walk GROUP BY 1, 2),
    lab AS (SELECT eps, num_id, dense_rank() OVER (PARTITION BY eps ORDER BY c) - 1 AS label FROM comp),
    bord AS (SELECT nb.eps, nb.a AS num_id, min(label) AS label FROM nb JOIN lab ON lab.eps = nb.eps AND lab.num_id = nb.b
      WHERE NOT EXISTS (SELECT 1 FROM core k WHERE k.eps = nb.eps AND k.num_id = nb.a) GROUP BY 1, 2),
    every AS (SELECT * FROM lab UNION ALL SELECT * FROM bord)
    SELECT CAST(e.eps AS DOUBLE) AS eps, w.num_id, CAST(coalesce(label, -1) AS INT) AS label FROM wm w CROSS JOIN eps e LEFT JOIN every x ON x.eps = e.eps AND x.num_id = w.num_id"""
)


@query("cl_dbscan", _DBSCAN_SQL)
def cl_dbscan(spark, folder):
    return cluster.dbscan(trajectories(spark, folder), "num_id", "vec", _EPS, _MIN).select("eps", "num_id", "label")


def _dbscan_sweep_sql():
    head, tail = _DBSCAN_SQL.rsplit("SELECT CAST(e.eps AS DOUBLE)", 1)
    return head.rstrip() + f""",
    lb AS (SELECT CAST(e.eps AS DOUBLE){tail}),
    ct AS (SELECT eps, count(DISTINCT CASE WHEN label >= 0 THEN label END) AS clusters, avg(CAST(label < 0 AS INT)) AS noise_ratio FROM lb GROUP BY 1),
    both_ways AS (SELECT id_a AS a, id_b AS b, dist FROM dtw UNION ALL SELECT id_b, id_a, dist FROM dtw),
    tot AS (SELECT x.eps, x.num_id, x.label AS own, y.label AS other, sum(dist) AS total, count(*) AS n FROM lb x JOIN both_ways p ON p.a = x.num_id
      JOIN lb y ON y.eps = x.eps AND y.num_id = p.b WHERE x.label >= 0 AND y.label >= 0 GROUP BY 1, 2, 3, 4),
    ab AS (SELECT eps, num_id, max(CASE WHEN own = other THEN total / n END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM tot GROUP BY 1, 2),
    sil AS (SELECT eps, avg(CASE WHEN b IS NOT NULL THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS s FROM ab GROUP BY 1)
    SELECT ct.eps, clusters, round(noise_ratio, 6) AS noise_ratio, round(CASE WHEN clusters > 1 THEN coalesce(s, 0) ELSE 0 END, 6) + 0.0 AS silhouette
    FROM ct LEFT JOIN sil ON sil.eps = ct.eps"""


@query("cl_dbscan_sweep", _dbscan_sweep_sql())
def cl_dbscan_sweep(spark, folder):
    return round_doubles(cluster.dbscan_sweep(trajectories(spark, folder), "num_id", "vec", _EPS, _MIN))


@query("cl_mds")
def cl_mds(spark, folder):
    placed = cluster.classical_scaling(trajectories(spark, folder), "num_id", "vec", "dtw")
    return placed.select("num_id", r6(F.get("embedding", F.lit(0))).alias("x"), r6(F.get("embedding", F.lit(1))).alias("y"))


@query("cl_sweep")
def cl_sweep(spark, folder):
    return round_doubles(cluster.distance_analysis(_week_matrix(spark, folder), WEEK_COLS, "num_id", "dtw")[1])


@query("cl_kmeans")
def cl_kmeans(spark, folder):
    return cluster.kmeans_labels(vectors(spark, folder), "vec", 10, n_init=2)[0].select("vec_id", "label", "cluster")


def _variable_distance(spark, folder):
    return stats.distance_from_correlation(stats.correlation_edges(fx.sensor_day(spark, folder), VARS))


@query("cl_hier")
def cl_hier(spark, folder):
    return cluster.map_table(spark, cluster.variable_clusters(_variable_distance(spark, folder), 3))


@query("cl_hier_subjects")
def cl_hier_subjects(spark, folder):
    return cluster.subject_hierarchy(trajectories(spark, folder), "num_id", "vec", 4, metric="dtw").select("num_id", "cluster")


def _hier(linkage, metric):
    def run(spark, folder):
        return cluster.subject_hierarchy(trajectories(spark, folder), "num_id", "vec", 4, linkage, metric).select("num_id", "cluster")

    return run


query("cl_hier_complete")(_hier("complete", "dtw"))
query("cl_hier_average")(_hier("average", "dtw"))
query("cl_hier_ward")(_hier("ward", "euclidean"))


@query("cl_merge_table")
def cl_merge_table(spark, folder):
    return round_doubles(cluster.merge_table(_variable_distance(spark, folder)))


@query(
    "cl_comember",
    """WITH t AS (SELECT l_suppkey % 7 AS a, l_partkey % 5 AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
    p AS (SELECT sum(n * (n - 1) / 2.0) AS tog FROM t),
    x AS (SELECT sum(n * (n - 1) / 2.0) AS one FROM (SELECT sum(n) AS n FROM t GROUP BY a)),
    y AS (SELECT sum(n * (n - 1) / 2.0) AS two FROM (SELECT sum(n) AS n FROM t GROUP BY b)), z AS (SELECT count(*) AS n FROM lineitem)
    SELECT round(tog / (n * (n - 1) / 2.0), 6) AS co_member, round(tog / (one + two - tog), 6) AS jaccard FROM p, x, y, z""",
)
def cl_comember(spark, folder):
    labels = fx.table(spark, folder, "lineitem").select((F.col("l_suppkey") % 7).alias("a"), (F.col("l_partkey") % 5).alias("b"))
    return round_doubles(cluster.co_membership(labels, "a", "b"))


@query("cl_stability")
def cl_stability(spark, folder):
    return round_doubles(cluster.stability(trajectories(spark, folder), "num_id", "vec"))


@query("cl_trajectory")
def cl_trajectory(spark, folder):
    """Weekly means, time-warped distances, two clusters, and the clusters compared."""
    labels = cluster.distance_row_kmeans(trajectories(spark, folder), "num_id", "vec", 2, "dtw").select("num_id", "cluster")
    return round_doubles(stats.compare_clusters(fx.sensor_day(spark, folder).join(labels, "num_id"), "cluster", "all_mean"))
