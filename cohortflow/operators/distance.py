"""Pairwise distances in fixed-size blocks.

Points are hashed into blocks and every pair of blocks is one row of work, compared in tiles of
about `BLOCK_ROWS` rows, so each task holds bounded matrices however many points there are. Large tables
move blocks of `TILES` tiles, which moves each point less often. What leaves a block pair is a reduction
(sums, counts, spanning links); only `distance_edges`, whose result is the distance matrix itself,
returns one row per pair. Reductions compare each distinct vector once and weigh it by its copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..session import cut_lineage

BLOCK_ROWS = 1024  # rows of a tile
TILES = 8  # tiles of a block of a large table
LEAST_BLOCKS = 24  # a table has so many blocks before its blocks grow
CELLS = 1 << 15  # distances computed at a time: they stay in a core's cache


def _slices(a: np.ndarray, b: np.ndarray):
    step = max(1, CELLS // max(1, len(b)))
    return (slice(at, at + step) for at in range(0, len(a), step))


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total, there = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    for some in _slices(a, b):
        part = total[some]
        for k in range(a.shape[1]):
            gap = a[some, k, None] - there[k]
            gap *= gap
            part += gap
        np.sqrt(part, out=part)
    return total


def near_euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product, for sums of many: the last digits may differ from `euclidean`.

    Small distances, where the product cancels, are taken from the differences.
    """
    if a.shape[1] < 8 or not (len(a) and len(b) and np.isfinite(a).all() and np.isfinite(b).all()):
        return euclidean(a, b)
    centre = b.mean(axis=0)
    x, y = a - centre, b - centre
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    d = x @ y.T
    d *= -2.0
    d += xx[:, None]
    d += yy
    i, j = np.nonzero(d <= 1e-6 * (xx.max() + yy.max()))
    for at in range(0, len(i), CELLS):
        p, q = i[at : at + CELLS], j[at : at + CELLS]
        d[p, q] = np.square(a[p] - b[q]).sum(axis=1)
    return np.sqrt(d, out=d)


def dtw(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic time warping with absolute differences, for all pairs of two blocks at once."""
    out, there = np.empty((len(a), len(b))), np.ascontiguousarray(b.T)
    for some in _slices(a, b):
        above = None
        for i in range(a.shape[1]):
            row = []
            for j in range(b.shape[1]):
                cost = a[some, i, None] - there[j]
                np.abs(cost, out=cost)
                before = []
                if j:
                    before.append(row[j - 1])
                if above is not None:
                    before.append(above[j])
                    if j:
                        before.append(above[j - 1])
                if before:
                    least = before[0] if len(before) == 1 else np.minimum(before[0], before[1])
                    if len(before) == 3:
                        np.minimum(least, before[2], out=least)
                    cost += least
                row.append(cost)
            above = row
        out[some] = above[-1]
    return out


METRICS = {"euclidean": euclidean, "dtw": dtw}
SUMMED = {"euclidean": near_euclidean, "dtw": dtw}


def paired(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of `a` to the same row of `b`."""
    if metric == "euclidean":
        total = np.zeros(len(a))
        for x, y in zip(a.T, b.T):
            total += (x - y) ** 2
        return np.sqrt(total)
    return np.array([METRICS[metric](a[i : i + 1], b[i : i + 1])[0, 0] for i in range(len(a))])


def with_vector(df: DataFrame, cols: list[str], out: str = "vec") -> DataFrame:
    """Columns packed into one array; rows with a gap have no position and are left out."""
    return df.na.drop(subset=cols).withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def distinct_vectors(points: DataFrame, id_col: str, vec: str) -> DataFrame:
    """One row (id, _v, _w) per distinct vector: its smallest id and its number of copies."""
    rows = points.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_v"))
    return cut_lineage(rows.groupBy("_v").agg(F.min("_id").alias("id"), F.count(F.lit(1)).cast("double").alias("_w")))


def with_place(points: DataFrame, vec: str, places: DataFrame) -> DataFrame:
    """Points with `_place`, the id that stands for their vector."""
    return points.withColumn("_v", F.col(vec).cast("array<double>")).join(places.select("_v", F.col("id").alias("_place")), "_v").drop("_v")


def _blocks(points: DataFrame, keys: list[str], id_col: str, vec: str, carried: list[str], reach: float | None, block_rows: int):
    """Rows (keys, bin, sub, members) and the number of blocks per bin."""
    place = F.floor(F.get(vec, F.lit(0)) / F.lit(float(reach))) if reach else F.lit(0)
    rows = points.select(
        *keys, id_col, F.col(vec).cast("array<double>").alias("_v"), *carried, place.cast("bigint").alias("_bin")
    )
    n = F.count(F.lit(1))
    subs = F.least(F.ceil(n / block_rows), F.greatest(F.lit(LEAST_BLOCKS).cast("bigint"), F.ceil(n / (block_rows * TILES))))
    counts = rows.groupBy(*keys, "_bin").agg(subs.cast("bigint").alias("_subs"))
    member = F.struct(F.col(id_col).alias("id"), F.col("_v").alias("v"), *carried)
    blocks = (
        rows.join(counts, [*keys, "_bin"])
        .withColumn("_sub", F.pmod(F.xxhash64(id_col), F.col("_subs")))
        .groupBy(*keys, "_bin", "_sub")
        .agg(F.collect_list(member).alias("m"))
    )
    return blocks, counts


def block_pairs(
    points: DataFrame, id_col: str, vec: str, keys: list[str] = (), carried: list[str] = (), reach: float | None = None, block_rows: int | None = None
) -> DataFrame:
    """One row per pair of blocks to compare: keys, `a`, `b` (member arrays) and `same`.

    With `reach`, points are first binned by their first coordinate; both metrics are at least the
    first-coordinate difference, so only equal and neighbouring bins can hold points within reach.
    `id_col` must be unique within `keys`, which bounds the size of a block.
    """
    keys = list(keys)
    blocks, counts = _blocks(points, keys, id_col, vec, list(carried), reach, block_rows or BLOCK_ROWS)
    near_bins = F.array(F.col("_ba"), F.col("_ba") + 1) if reach else F.array(F.col("_ba"))
    left = blocks.select(*keys, F.col("_bin").alias("_ba"), F.col("_sub").alias("_sa"), F.col("m").alias("a"))
    plan = left.select(*keys, "_ba", "_sa").withColumn("_bin", F.explode(near_bins)).join(counts, [*keys, "_bin"])
    first = F.when(F.col("_bin") == F.col("_ba"), F.col("_sa")).otherwise(0)
    plan = plan.select(*keys, "_ba", "_sa", "_bin", F.explode(F.sequence(first, F.col("_subs") - 1)).alias("_sub"))
    right = blocks.withColumnRenamed("m", "b")
    # the pairs of one block would share a task
    tasks = 2 * points.sparkSession.sparkContext.defaultParallelism
    return (
        plan.join(left, [*keys, "_ba", "_sa"])
        .join(right, [*keys, "_bin", "_sub"])
        .repartition(tasks, *keys, "_ba", "_sa", "_bin", "_sub")
        .select(*keys, "a", "b", ((F.col("_ba") == F.col("_bin")) & (F.col("_sa") == F.col("_sub"))).alias("same"))
    )


class Block:
    """Arrays of one block taken from an Arrow list of structs."""

    def __init__(self, members: pa.StructArray):
        self.ids = members.field("id").to_numpy(zero_copy_only=False)
        self.members = members
        n = len(self.ids)
        # a member struct may be a slice of a larger batch: flatten honours the offsets
        self.v = members.field("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

    def tiles(self, rows: int) -> list[Block]:
        n = len(self.ids)
        edges = np.linspace(0, n, max(1, round(n / rows)) + 1).astype(int)
        return [Block(self.members.slice(i, j - i)) for i, j in zip(edges[:-1], edges[1:])] if len(edges) > 2 else [self]

    def column(self, name: str) -> np.ndarray:
        return self.members.field(name).to_numpy(zero_copy_only=False)

    def nested(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a column of matrices, one below the other, and where each member's begin."""
        lists = self.members.field(name)
        rows = lists.flatten()
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1), np.cumsum(counts) - counts

    def lists(self, name: str) -> list:
        return self.members.field(name).to_pylist()


def map_pairs(pairs: DataFrame, keys: list[str], schema: StructType, work, tiled: bool = True) -> DataFrame:
    """Apply `work(a, b, same) -> tuple of columns` to every block pair, a pair of tiles at a time; keys are repeated."""
    full = StructType([*[pairs.schema[k] for k in keys], *schema.fields])
    arrow = to_arrow_schema(full)
    rows = BLOCK_ROWS

    def parts(a, b, same):
        if not tiled:
            return [(a, b, same)]
        left, right = a.tiles(rows), b.tiles(rows)
        return ((x, y, same and i == j) for i, x in enumerate(left) for j, y in enumerate(right) if not same or i <= j)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                fixed = [batch.column(k)[r].as_py() for k in keys]
                for a, b, same in parts(Block(batch.column("a")[r].values), Block(batch.column("b")[r].values), batch.column("same")[r].as_py()):
                    columns = work(a, b, same)
                    n = len(columns[0])
                    if n:
                        repeated = [pa.array([k] * n, arrow.field(i).type) for i, k in enumerate(fixed)]
                        data = [pa.array(c, arrow.field(len(keys) + i).type) for i, c in enumerate(columns)]
                        yield pa.RecordBatch.from_arrays([*repeated, *data], schema=arrow)

    return pairs.mapInArrow(run, full)


def _upper(same: bool, shape: tuple[int, int]) -> np.ndarray:
    return np.triu(np.ones(shape, bool), 1) if same else np.ones(shape, bool)


def distance_edges(points: DataFrame, id_col: str, vec: str, metric: str = "euclidean", within: float | None = None) -> DataFrame:
    """Distance matrix as edges (id_a < id_b), optionally only those within a radius."""
    kind = points.schema[id_col].dataType
    schema = StructType([StructField("id_a", kind), StructField("id_b", kind), StructField("dist", DoubleType())])
    measure = METRICS[metric]

    def work(a, b, same):
        d = measure(a.v, b.v)
        keep = _upper(same, d.shape)
        if within is not None:
            keep &= d <= within
        i, j = np.nonzero(keep)
        left, right = a.ids[i], b.ids[j]
        return np.where(left < right, left, right), np.where(left < right, right, left), d[i, j]

    return map_pairs(block_pairs(points, id_col, vec, reach=within), [], schema, work)


def distance_stats(points: DataFrame, id_col: str, vec: str, metric: str = "euclidean") -> DataFrame:
    """Smallest, largest and mean entry of the full matrix, zero diagonal included; a block pair returns three numbers."""
    measure = SUMMED[metric]
    schema = StructType([StructField(n, DoubleType()) for n in ("low", "high", "total", "entries")])

    def work(a, b, same):
        d = measure(a.v, b.v)
        wa, wb, sides = a.column("_w"), b.column("_w"), 1 if same else 2
        return [d.min()], [d.max()], [wa @ d @ wb * sides], [wa.sum() * wb.sum() * sides]

    places = distinct_vectors(points, id_col, vec)
    reduced = map_pairs(block_pairs(places, "id", "_v", carried=["_w"]), [], schema, work)
    found = reduced.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("entries").alias("entries"))
    return found.select(F.least("low", F.lit(0.0)).alias("min"), F.col("high").alias("max"), F.try_divide("total", "entries").alias("mean"))


def edge_stats(edges: DataFrame, n_points) -> DataFrame:
    """Smallest, largest and mean entry of the full matrix, zero diagonal included."""
    return edges.agg(
        F.least(F.min("dist"), F.lit(0.0)).alias("min"),
        F.max("dist").alias("max"),
        (2 * F.sum("dist") / (n_points * n_points)).alias("mean"),
    )


def silhouette(
    points: DataFrame, id_col: str, vec: str, label: str, keys: list[str] = (), metric: str = "euclidean", per_point: bool = False
) -> DataFrame:
    """Exact mean silhouette (per `keys` group). Block pairs return distance sums per point and cluster."""
    keys = list(keys)
    rows = points.select(*keys, F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("_v"), F.col(label).cast("int").alias("_label"))
    places = rows.groupBy(*keys, "_v", "_label").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    places = cut_lineage(places.withColumn("_place", F.monotonically_increasing_id()))
    schema = StructType([StructField("_place", LongType()), StructField("own", IntegerType()), StructField("other", IntegerType()), StructField("total", DoubleType())])
    measure = SUMMED[metric]

    def one_way(d, a, b):
        own, other = a.column("_label"), b.column("_label")
        labels, code = np.unique(other, return_inverse=True)
        member = np.zeros((len(other), len(labels)))
        member[np.arange(len(other)), code] = b.column("_w")
        sums = d @ member
        return np.repeat(a.ids, len(labels)), np.repeat(own, len(labels)), np.tile(labels, len(a.ids)), sums.ravel()

    def work(a, b, same):
        d = measure(a.v, b.v)
        forward = one_way(d, a, b)
        return forward if same else tuple(np.concatenate(x) for x in zip(forward, one_way(d.T, b, a)))

    sums = map_pairs(block_pairs(places, "_place", "_v", keys, ["_label", "_w"]), keys, schema, work)
    sums = sums.groupBy(*keys, "_place", "own", "other").agg(F.sum("total").alias("total"))
    members = rows.join(places.drop("_w"), [*keys, "_v", "_label"]).select(*keys, "id", "_place")
    sums = members.join(sums, [*keys, "_place"]).groupBy(*keys, "id", "own", "other").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy(*keys, F.col("_label").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    mine = F.col("own") == F.col("other")
    ab = sums.join(sizes, [*keys, "other"]).groupBy(*keys, "id").agg(
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("size"))).alias("b"),
    )
    # a cluster of one has no inner distance and scores 0
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    scored = ab.withColumn("s", F.when(F.col("b").isNotNull(), score))
    if per_point:
        return scored.select(*keys, F.col("id").alias(id_col), "s")
    return scored.groupBy(*keys).agg(F.avg("s").alias("silhouette"))


def _euclid(a: str, b: str):
    gap = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def davies_bouldin(points: DataFrame, vec: str, label: str, dim: int, keys: list[str] = ()) -> DataFrame:
    keys = list(keys)
    rows = points.select(*keys, F.col(label).alias("_l"), F.col(vec).cast("array<double>").alias("_v"))
    centre = F.array(*[F.avg(F.get("_v", F.lit(i))) for i in range(dim)])
    centroids = rows.groupBy(*keys, "_l").agg(centre.alias("_c"))
    spread = rows.join(centroids, [*keys, "_l"]).groupBy(*keys, "_l").agg(F.avg(_euclid("_v", "_c")).alias("_s"))
    # one row per cluster from here on
    side = centroids.join(spread, [*keys, "_l"])
    left = side.withColumnsRenamed({"_l": "_la", "_c": "_ca", "_s": "_sa"})
    right = side.withColumnsRenamed({"_l": "_lb", "_c": "_cb", "_s": "_sb", **{k: f"_r_{k}" for k in keys}})
    on = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_la") != F.col("_lb")]
    ratio = F.try_divide(F.col("_sa") + F.col("_sb"), _euclid("_ca", "_cb"))
    worst = left.join(right, on).groupBy(*keys, "_la").agg(F.max(ratio).alias("_w"))
    return worst.groupBy(*keys).agg(F.avg("_w").alias("davies_bouldin"))


def _representatives(link: np.ndarray, bipartite: bool) -> np.ndarray:
    """Smallest member index of each node's connected component."""
    n, m = link.shape
    if not bipartite:
        label = np.arange(n)
        while True:
            near = np.where(link, label[None, :], n).min(axis=1, initial=n)
            new = np.minimum(label, near)
            new = new[new]
            if (new == label).all():
                return label
            label = new
    label = np.arange(n + m)
    while True:
        new = label.copy()
        new[:n] = np.minimum(label[:n], np.where(link, label[None, n:], n + m).min(axis=1, initial=n + m))
        new[n:] = np.minimum(label[n:], np.where(link, new[:n, None], n + m).min(axis=0, initial=n + m))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def neighbour_counts(points: DataFrame, id_col: str, vec: str, radii: list[float], metric: str, weight: str | None = None) -> DataFrame:
    """Neighbours within each radius, the point itself included: (r, id, n). A point counts `weight` times, or once."""
    kind = points.schema[id_col].dataType
    schema = StructType([StructField("r", IntegerType()), StructField("id", kind), StructField("n", LongType())])
    measure = METRICS[metric]

    def work(a, b, same):
        d = measure(a.v, b.v)
        wa, wb = (x.column(weight) if weight else np.ones(len(x.ids)) for x in (a, b))
        out = []
        for r, radius in enumerate(radii):
            near = (d <= radius).astype(float)
            out.append((np.full(len(a.ids), r), a.ids, (near @ wb).astype(int)))
            if not same:
                out.append((np.full(len(b.ids), r), b.ids, (wa @ near).astype(int)))
        return tuple(np.concatenate(x) for x in zip(*out))

    pairs = block_pairs(points, id_col, vec, carried=[weight] if weight else [], reach=max(radii))
    return map_pairs(pairs, [], schema, work).groupBy("r", "id").agg(F.sum("n").alias("n"))


def density_links(points: DataFrame, id_col: str, vec: str, core_in: str, radii: list[float], metric: str) -> DataFrame:
    """Links (r, a, b, border) that span the core-core graph and attach border points.

    `core_in` lists the radii at which a point is core. Per block pair and radius, core points of a
    component are linked to one representative (at most one link per point, not one per pair); a
    border point has fewer than the minimum number of neighbours, so its links are few.
    """
    kind = points.schema[id_col].dataType
    schema = StructType([StructField("r", IntegerType()), StructField("a", kind), StructField("b", kind), StructField("border", IntegerType())])
    measure = METRICS[metric]

    def flags(block):
        lists = block.lists(core_in)
        return [np.array([r in set(x or ()) for x in lists]) for r in range(len(radii))]

    def work(a, b, same):
        d = measure(a.v, b.v)
        core_a, core_b = flags(a), flags(b)
        out = [(np.empty(0, int), a.ids[:0], a.ids[:0], np.empty(0, int))]
        for r, radius in enumerate(radii):
            near = d <= radius
            ca, cb = core_a[r], core_b[r]
            rep = _representatives(near & ca[:, None] & cb[None, :], bipartite=not same)
            ids = a.ids if same else np.concatenate([a.ids, b.ids])
            moved = np.nonzero(rep != np.arange(len(rep)))[0]
            out.append((np.full(len(moved), r), ids[moved], ids[rep[moved]], np.zeros(len(moved), int)))
            i, j = np.nonzero(near & ~ca[:, None] & cb[None, :])
            out.append((np.full(len(i), r), a.ids[i], b.ids[j], np.ones(len(i), int)))
            if not same:
                i, j = np.nonzero(near & ca[:, None] & ~cb[None, :])
                out.append((np.full(len(i), r), b.ids[j], a.ids[i], np.ones(len(i), int)))
        return tuple(np.concatenate(x) for x in zip(*out))

    pairs = block_pairs(points, id_col, vec, carried=[core_in], reach=max(radii))
    return map_pairs(pairs, [], schema, work).distinct()


def spanning_edges(points: DataFrame, id_col: str, vec: str, metric: str) -> DataFrame:
    """Minimum spanning tree edges of every block pair; their union contains the overall tree."""
    kind = points.schema[id_col].dataType
    schema = StructType([StructField("id_a", kind), StructField("id_b", kind), StructField("dist", DoubleType())])
    measure = METRICS[metric]

    def work(a, b, same):
        ids = a.ids if same else np.concatenate([a.ids, b.ids])
        v = a.v if same else np.concatenate([a.v, b.v])
        d = measure(v, v)
        n = len(ids)
        best, origin, inside = d[0].copy(), np.zeros(n, int), np.zeros(n, bool)
        inside[0] = True
        at, to, dist = [], [], []
        for _ in range(n - 1):
            nxt = int(np.argmin(np.where(inside, np.inf, best)))
            at.append(origin[nxt]), to.append(nxt), dist.append(best[nxt])
            inside[nxt] = True
            closer = d[nxt] < best
            best[closer], origin[closer] = d[nxt][closer], nxt
        left, right = ids[np.array(at, int)], ids[np.array(to, int)]
        return np.where(left < right, left, right), np.where(left < right, right, left), np.array(dist)

    return map_pairs(block_pairs(points, id_col, vec), [], schema, work).distinct()
