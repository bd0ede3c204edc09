import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import batched, cluster, distance, graph, resampled


@pytest.fixture(scope="module")
def points(spark):
    """Two dense clouds with many exact copies, a bridge and some noise."""
    rng = np.random.default_rng(3)
    x = np.concatenate([
        rng.normal(0, 0.3, (25, 3)), np.tile([[0.1, 0.1, 0.1]], (15, 1)), rng.normal(4, 0.3, (18, 3)), rng.uniform(-10, 10, (8, 3)),
    ]).round(2)
    df = spark.createDataFrame([(i, [float(v) for v in row], int(i >= 40)) for i, row in enumerate(x)], "id long, vec array<double>, label int")
    return df.repartition(3), x


def naive_dtw(a, b):
    t = np.full((len(a) + 1, len(b) + 1), np.inf)
    t[0, 0] = 0
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1, j + 1] = abs(a[i] - b[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def matrix(x, metric):
    pair = (lambda a, b: np.sqrt(((a - b) ** 2).sum())) if metric == "euclidean" else naive_dtw
    return np.array([[pair(a, b) for b in x] for a in x])


@pytest.mark.parametrize("metric", ["euclidean", "dtw"])
@pytest.mark.parametrize("block", [16, 1024])
def test_distance_edges(points, metric, block, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK_ROWS", block)
    df, x = points
    d = matrix(x, metric)
    got = {(r["id_a"], r["id_b"]): r["dist"] for r in distance.distance_edges(df, "id", "vec", metric).collect()}
    assert len(got) == len(x) * (len(x) - 1) // 2
    assert all(np.isclose(d[a, b], v) for (a, b), v in got.items())
    near = {(r["id_a"], r["id_b"]) for r in distance.distance_edges(df, "id", "vec", metric, within=0.7).collect()}
    assert near == {(a, b) for (a, b) in got if d[a, b] <= 0.7}


def naive_dbscan(d, eps, min_samples):
    near = d <= eps
    core = near.sum(axis=1) >= min_samples
    label = np.full(len(d), -1)
    c = 0
    for i in range(len(d)):
        if core[i] and label[i] == -1:
            stack = [i]
            label[i] = c
            while stack:
                k = stack.pop()
                if not core[k]:
                    continue
                for j in np.nonzero(near[k])[0]:
                    if label[j] == -1:
                        label[j] = c
                        stack.append(j)
            c += 1
    return label


def test_dbscan(points, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK_ROWS", 16)
    df, x = points
    d = matrix(x, "dtw")
    radii = [0.7, 6.0]
    got = cluster.dbscan(df, "id", "vec", radii, 5, "dtw").toPandas()
    for eps in radii:
        mine = got[got.eps == eps].sort_values("id")["label"].to_numpy()
        assert (mine == naive_dbscan(d, eps, 5)).all()


def test_silhouette(points, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK_ROWS", 16)
    df, x = points
    d, lab = matrix(x, "euclidean"), (np.arange(len(x)) >= 40).astype(int)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        a, b = d[i, own].sum() / (own.sum() - 1), d[i, ~own].mean()
        s.append((b - a) / max(a, b))
    assert distance.silhouette(df, "id", "vec", "label").first()["silhouette"] == pytest.approx(np.mean(s))


def test_spanning_tree_and_single_linkage(points, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK_ROWS", 30)
    df, x = points
    d = matrix(x, "euclidean")
    tree = graph.minimum_spanning_tree(df.select("id"), distance.spanning_edges(df, "id", "vec", "euclidean"))
    steps = cluster.linkage_steps(d, "single")
    assert tree.count() == len(x) - 1
    assert np.allclose(sorted(r["dist"] for r in tree.collect()), sorted(h for _, _, h, _ in steps))


def test_components_of_a_long_path(spark):
    nodes = spark.range(40).withColumnRenamed("id", "n")
    links = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a != 20")
    got = {r["id"]: r["component"] for r in graph.connected_components(nodes, links, id_col="n").collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(40)}


def test_linkage_heights():
    x = np.array([[0.0], [1.0], [5.0], [7.0], [20.0]])
    d = np.abs(x - x.T)
    # heights worked out by hand
    assert [h for *_, h, _ in cluster.linkage_steps(d, "single")] == [1, 2, 4, 13]
    assert [h for *_, h, _ in cluster.linkage_steps(d, "complete")] == [1, 2, 7, 20]
    assert [h for *_, h, _ in cluster.linkage_steps(d, "average")] == pytest.approx([1, 2, 5.5, 16.75])
    ward = [h for *_, h, _ in cluster.linkage_steps(d, "ward")]
    assert ward[:3] == pytest.approx([1, 2, np.sqrt(2 * 2 * 2 / 4 * 5.5**2)])


def test_embedding_keeps_distances(points):
    df, x = points
    flat = df.withColumn("vec", F.array(F.get("vec", F.lit(0)), F.get("vec", F.lit(1))))
    out = cluster.classical_scaling(flat, "id", "vec").toPandas().sort_values("id")
    e = np.stack(out["embedding"])
    assert np.allclose(matrix(e, "euclidean"), matrix(x[:, :2], "euclidean"), atol=1e-6)


@pytest.mark.parametrize("n", [3, 100, 2000])
def test_scaling_uses_every_point(spark, n):
    """More points than a block holds; squared distances are those of classical scaling in NumPy."""
    x = np.random.default_rng(n).normal(0, np.arange(1, 7)[::-1] ** 1.5, (n, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    out = cluster.classical_scaling(df, "id", "vec").toPandas().sort_values("id")
    centred = x - x.mean(axis=0)
    u, size, _ = np.linalg.svd(centred, full_matrices=False)
    exact = u[:, :2] * size[:2]
    assert np.allclose(np.abs(np.stack(out["embedding"])), np.abs(exact), atol=1e-5)


def test_row_kmeans_is_lloyd_on_the_distance_matrix(points, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK_ROWS", 16)
    df, x = points
    d = matrix(x, "dtw")
    got = cluster.distance_row_kmeans(df, "id", "vec", 3, "dtw").toPandas().sort_values("id")["cluster"].to_numpy()
    assert got[0] == 0 and set(got) == {0, 1, 2}
    centres = np.array([d[got == c].mean(axis=0) for c in range(3)])
    assert (np.square(d[:, None] - centres[None]).sum(axis=2).argmin(axis=1) == got).all()


@pytest.mark.parametrize("few", [0, 4096])
def test_row_kmeans_takes_the_matrix_once_a_round(spark, monkeypatch, few):
    """The matrix once for the start, once for the first sums, then once a round; sums of moved points lead to plain Lloyd steps."""
    x = np.random.default_rng(1).uniform(-1, 1, (40, 3))
    d = matrix(x, "dtw")
    first = int(np.round(d.sum(axis=1), 9).argmax())
    label, rounds = np.where(d[:, first] <= d[:, np.round(d[:, first], 9).argmax()], 0, 1), 0
    while True:
        rounds += 1
        centres = np.array([d[label == c].mean(axis=0) for c in range(2)])
        fresh = np.square(d[:, None] - centres[None]).sum(axis=2).argmin(axis=1)
        if (fresh == label).all():
            break
        label = fresh
    asked = []
    whole = cluster.distance_products
    monkeypatch.setattr(cluster, "distance_products", lambda *a, **k: asked.append(1) or whole(*a, **k))
    monkeypatch.setattr(cluster, "FEW", few)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = cluster.distance_row_kmeans(df, "id", "vec", 2, "dtw").toPandas().sort_values("id")["cluster"].to_numpy()
    assert rounds > 1 and len(asked) == 2 + rounds
    assert (got == (label != label[0])).all()


def test_scaling_takes_few_steps(spark, monkeypatch):
    """More spare columns find the same coordinates in fewer products with the matrix."""
    x = np.random.default_rng(2).normal(size=(120, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    asked = []
    whole = cluster.distance_products
    monkeypatch.setattr(cluster, "distance_products", lambda *a, **k: asked.append(1) or whole(*a, **k))
    place = lambda: np.stack(cluster.classical_scaling(df, "id", "vec", "dtw").toPandas().sort_values("id")["embedding"])
    many = place()
    steps = len(asked)
    monkeypatch.setattr(cluster, "SPARE", 2)
    few = place()
    assert steps < len(asked) - steps
    assert np.allclose(many, few, atol=1e-5)


@pytest.mark.parametrize("linkage", cluster.LINKAGES)
@pytest.mark.parametrize("metric", ["euclidean", "dtw"])
def test_subject_linkages(points, monkeypatch, linkage, metric):
    monkeypatch.setattr(distance, "BLOCK_ROWS", 20)
    df, x = points
    x = x + np.random.default_rng(4).normal(0, 0.01, x.shape)  # no ties
    df = df.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    if linkage == "ward" and metric == "dtw":
        with pytest.raises(ValueError):
            cluster.subject_hierarchy(df, "id", "vec", 4, linkage, metric)
        return
    members = {i: [i] for i in range(len(x))}
    for s, (a, b, _, _) in enumerate(cluster.linkage_steps(matrix(x, metric), linkage)[: len(x) - 4]):
        members[len(x) + s] = members.pop(a) + members.pop(b)
    want = {i: c for c, group in enumerate(sorted(members.values(), key=min)) for i in group}
    got = {r["id"]: r["cluster"] for r in cluster.subject_hierarchy(df, "id", "vec", 4, linkage, metric).collect()}
    assert got == want


def test_unknown_linkage_is_an_error(points):
    with pytest.raises(ValueError):
        cluster.subject_hierarchy(points[0], "id", "vec", 2, "median")


def test_variable_clusters_and_merge_table(spark):
    names = "abcde"
    x = {"a": 0.0, "b": 1.0, "c": 5.0, "d": 7.0, "e": 20.0}
    edges = spark.createDataFrame([(p, q, abs(x[p] - x[q])) for p, q in itertools.combinations(names, 2)], "var_i string, var_j string, dist double")
    assert cluster.variable_clusters(edges, 3, "average", rows_as_features=False) == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}
    rows = cluster.merge_table(edges).collect()
    assert len(rows) == 16 and [r["height"] for r in rows if r["method"] == "single"] == [1, 2, 4, 13]


def test_kmeans_labels_and_sweep(points):
    df, x = points
    labelled, cost = cluster.kmeans_labels(df, "vec", 1)
    assert cost == pytest.approx(np.square(x - x.mean(axis=0)).sum()) and {r["cluster"] for r in labelled.collect()} == {0}
    sweep = {r["k"]: r for r in cluster.kmeans_sweep(df, "id", "vec", range(1, 4)).collect()}
    assert sweep[1]["silhouette"] is None and sweep[3]["inertia"] <= sweep[2]["inertia"] <= sweep[1]["inertia"]


def separate_kmeans(x, centres):
    while True:
        label = np.array([np.argmin([((p - c) ** 2).sum() for c in centres]) for p in x])
        moved = np.array([x[label == j].mean(axis=0) if (label == j).any() else c for j, c in enumerate(centres)])
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            return label, ((x - centres[label]) ** 2).sum()
        centres = moved


def test_stability_equals_separate_fits(spark, monkeypatch):
    monkeypatch.setattr(batched, "NUMBERS", 250)  # two samples at a time
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (301, 2)) + rng.integers(0, 3, (301, 1)) + 50
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>").repartition(3)
    odd = df.union(spark.createDataFrame([(900, None), (901, [1.0, None])], df.schema))
    ks, starts, seed = [2, 3, 5, 151], 3, 42
    got = {(r["k"], r["bootstrap"]): r for r in cluster.stability(odd, "id", "vec", ks, 5, seed=seed, starts=starts).collect()}
    assert len(got) == 20 and all(got[151, b]["jaccard"] is None and got[151, b]["co_member"] is None for b in range(5))
    h = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id", F.lit(seed))).collect()], np.int64)
    for b in range(5):
        drawn = resampled.mixed(h, np.array([b]))[:, 0]
        member = np.sort(np.argsort(drawn)[:150])
        for k in ks[:3]:
            best = []
            for side in range(2):
                fits = []
                for s in range(starts):
                    first = resampled.mixed(h[member], np.array([batched.STARTS_FROM + b * 2 * starts + side * starts + s]))[:, 0]
                    fits.append(separate_kmeans(x[member], x[member][np.argsort(first)[:k]]))
                least = min(cost for _, cost in fits)
                best.append(next(label for label, cost in fits if cost <= least * (1 + 1e-9)))
            same = [label[:, None] == label[None, :] for label in best]
            upper = np.triu_indices(150, 1)
            both, either = (same[0] & same[1])[upper].sum(), (same[0] | same[1])[upper].sum()
            row = got[k, b]
            assert row["unconverged"] == 0
            assert row["co_member"] == pytest.approx(both / len(upper[0])) and row["jaccard"] == pytest.approx(both / either)


def test_stability_of_ward_and_of_few_points(points, spark):
    got = cluster.stability(points[0], "id", "vec", [2], 2, method="agg").collect()
    assert len(got) == 2 and all(r["jaccard"] == 1.0 and 0 < r["co_member"] < 1 for r in got)
    none = points[0].limit(0)
    assert [r["jaccard"] for r in cluster.stability(none, "id", "vec", [2], 2).collect()] == [None, None]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, vec array<double>")
    assert {(r["co_member"], r["jaccard"], r["unconverged"]) for r in cluster.stability(same, "id", "vec", [2, 3], 2, starts=2).collect()} == {(1.0, 1.0, 0)}


def test_distance_stats(points, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK_ROWS", 16)
    d = matrix(points[1], "euclidean")
    row = distance.distance_stats(points[0], "id", "vec").first()
    assert (row["min"], row["max"]) == (0.0, pytest.approx(d.max())) and row["mean"] == pytest.approx(d.mean())


def test_co_membership(spark):
    a, b = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 1]
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    pairs = list(itertools.combinations(range(6), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    either = sum(a[i] == a[j] or b[i] == b[j] for i, j in pairs)
    row = cluster.co_membership(df, "a", "b").first()
    assert row["co_member"] == pytest.approx(both / len(pairs)) and row["jaccard"] == pytest.approx(both / either)


@pytest.mark.parametrize("linkage", cluster.LINKAGES)
def test_copies_do_not_change_the_hierarchy(spark, monkeypatch, linkage):
    """Copies merge first: rounds and comparisons follow the distinct vectors, also where clusters outgrow the last task."""
    monkeypatch.setattr(distance, "BLOCK_ROWS", 8)
    monkeypatch.setattr(cluster, "LAST_CLUSTERS", 12)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 3, (30, 2)).repeat(rng.integers(1, 5, 30), axis=0)
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "id long, vec array<double>")
    rounds, before = [], cluster._nearest_clusters
    monkeypatch.setattr(cluster, "_nearest_clusters", lambda c, *a: rounds.append(c.count()) or before(c, *a))
    got = {r["id"]: r["cluster"] for r in cluster.subject_hierarchy(df, "id", "vec", 5, linkage).collect()}
    members = {i: [i] for i in range(len(x))}
    for s, (a, b, _, _) in enumerate(cluster.linkage_steps(matrix(x, "euclidean"), linkage)[: len(x) - 5]):
        members[len(x) + s] = members.pop(a) + members.pop(b)
    assert got == {i: c for c, group in enumerate(sorted(members.values(), key=min)) for i in group}
    assert linkage == "single" or rounds[0] == 30


def test_each_distinct_vector_is_compared_once(points, monkeypatch):
    """Sums over pairs weigh copies instead of comparing them."""
    df, x = points
    seen, before = [], distance.block_pairs
    monkeypatch.setattr(distance, "block_pairs", lambda p, *a, **k: seen.append(p.count()) or before(p, *a, **k))
    n = len(np.unique(x, axis=0))
    d = matrix(x, "dtw")
    row = distance.distance_stats(df, "id", "vec", "dtw").first()
    assert row["max"] == pytest.approx(d.max()) and row["mean"] == pytest.approx(d.mean())
    got = cluster.dbscan(df, "id", "vec", [0.7], 5, "dtw").toPandas().sort_values("id")["label"].to_numpy()
    assert (got == naive_dbscan(d, 0.7, 5)).all()
    assert n < len(x) and set(seen) == {n}


def test_distances_by_product_keep_small_ones():
    rng = np.random.default_rng(5)
    a = rng.normal(100, 1, (40, 16))
    b = np.concatenate([a[:10], a[10:20] + 1e-7, rng.normal(100, 1, (5, 16))])
    exact = np.sqrt(np.square(a[:, None] - b[None]).sum(axis=2))
    assert np.allclose(distance.near_euclidean(a, b), exact, rtol=1e-9, atol=0) and (np.diag(distance.near_euclidean(a, a)) == 0).all()


def test_assigned_points_of_each_sample():
    rng = np.random.default_rng(2)
    v, inside = rng.normal(size=(40, 3)), rng.random((40, 5)) < 0.4
    inside[:, 4] = False
    v1, norm = batched._members(v, inside)
    centres = rng.normal(size=(5, 4, 3))
    centres[:, 3] = centres[:, 1]  # equal centres: the first takes all
    nearest, gap = batched._assigned(v1, centres)
    for s in range(5):
        own = v[inside[:, s]]
        d = ((own[:, None] - centres[s]) ** 2).sum(axis=2)
        label = d[:, :3].argmin(axis=1)
        sums = np.array([[*own[label == j].sum(axis=0), (label == j).sum()] for j in range(4)])
        assert np.allclose(nearest[s] @ v1[s], sums) and np.isclose(gap[s] + norm[s], d.min(axis=1).sum() if len(own) else 0.0)
