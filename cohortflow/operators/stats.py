"""Correlation structure, group comparison and prediction metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import finite_correlation, infinite_to_null, safe_corr
from ..functions.special import chi2_p_value, ks_p_value, t_p_value
from .ordering import running_totals, unpivot, value_counts

# ---------------------------------------------------------------- correlation


def _pair_structs(cols: list[str], wrap=lambda r: r) -> Column:
    return F.array(
        *[
            F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), wrap(safe_corr(a, b)).alias("r"))
            for a, b in combinations(cols, 2)
        ]
    )


def correlation_edges(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r of every column pair over pairwise complete rows, in one aggregation."""
    return df.agg(_pair_structs(cols).alias("a")).select(F.inline("a"))


def target_correlation(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("variable"), safe_corr(c, target).alias("r")) for c in cols if c != target]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def subject_correlation(df: DataFrame, cols: list[str], key: str = "num_id") -> DataFrame:
    """Upper triangle of each subject's correlation matrix in long form; undefined r is 0.

    Subjects without a single varying column are left out.
    """
    varies = [F.coalesce(F.min(c) < F.max(c), F.lit(False)) for c in cols]
    any_varies = varies[0]
    for v in varies[1:]:
        any_varies = any_varies | v
    grouped = df.groupBy(key).agg(_pair_structs(cols, finite_correlation).alias("a"), any_varies.alias("_any"))
    return grouped.filter("_any").select(key, F.inline("a"))


def flatten_correlation(edges: DataFrame, cols: list[str], key: str = "num_id") -> DataFrame:
    """One vector per subject, pairs in column order. A subject has one row per column pair."""
    place = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    rows = edges.withColumns({"_i": place[F.col("var_i")], "_j": place[F.col("var_j")]})
    packed = F.sort_array(F.collect_list(F.struct("_i", "_j", "r")))
    return rows.groupBy(key).agg(F.transform(packed, lambda s: s["r"]).alias("vector"))


def average_distance(edges: DataFrame) -> DataFrame:
    """1 - mean r over subjects."""
    return edges.groupBy("var_i", "var_j").agg((1 - F.avg("r")).alias("dist"))


def distance_from_correlation(edges: DataFrame) -> DataFrame:
    return edges.select("var_i", "var_j", (1 - F.col("r")).alias("dist"))


def condensed_distance(df: DataFrame, cols: list[str], key: str = "num_id") -> DataFrame:
    """Complete rows, subject means, correlation across subjects, 1 - r for each pair."""
    complete = df.na.drop(subset=cols)
    means = complete.groupBy(key).agg(*[infinite_to_null(F.avg(c)).alias(c) for c in cols])
    return distance_from_correlation(correlation_edges(means, cols))


def network_edges(edges: DataFrame, threshold: float = 0.5, scale: bool = False, keys: list[str] = ()) -> DataFrame:
    """Strong correlations as graph edges: weight 5r, sign, and a line width of 1 to 10 when scaled."""
    strong = edges.filter(F.abs("r") > threshold).withColumns(
        {"weight": F.col("r") * 5, "sign": F.when(F.col("r") < 0, -1).otherwise(1)}
    )
    if not scale:
        return strong.withColumn("width", F.col("weight"))
    # one row per column pair of a graph: the group is bounded by the variable count
    graph = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    low, high = F.min("weight").over(graph), F.max("weight").over(graph)
    width = F.when(high == low, F.lit(5.0)).otherwise(F.try_divide(F.col("weight") - low, high - low) * 9 + 1)
    return strong.withColumn("width", width)


def variance_kept(df: DataFrame, cols: list[str], threshold: float = 0.005) -> DataFrame:
    """Columns whose population variance exceeds the threshold."""
    packed = [F.struct(F.lit(c).alias("variable"), F.var_pop(c).alias("variance")) for c in cols]
    return df.agg(F.array(*packed).alias("a")).select(F.inline("a")).filter(F.col("variance") > threshold)


def prune_correlated(df: DataFrame, cols: list[str], target: str, threshold: float = 0.9) -> DataFrame:
    """Features to drop: of each pair with |r| above the threshold, the one less correlated with
    the target. On a tie the first by name stays."""
    cols = [c for c in cols if c != target]
    edges = correlation_edges(df, cols).filter(F.abs("r") > threshold)
    strength = target_correlation(df, cols, target).select("variable", F.coalesce(F.abs("r"), F.lit(0.0)).alias("s"))
    left = strength.select(F.col("variable").alias("var_i"), F.col("s").alias("s_i"))
    right = strength.select(F.col("variable").alias("var_j"), F.col("s").alias("s_j"))
    pairs = edges.join(left, "var_i").join(right, "var_j")
    weaker = (
        F.when(F.col("s_i") < F.col("s_j"), F.col("var_i"))
        .when(F.col("s_i") > F.col("s_j"), F.col("var_j"))
        .otherwise(F.greatest("var_i", "var_j"))
    )
    return pairs.select(weaker.alias("variable")).distinct()


# ---------------------------------------------------------- group comparison


def _group_moments(df: DataFrame, cluster: str, value: str) -> DataFrame:
    return df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")
    )


def _cluster_pairs(moments: DataFrame, cluster: str) -> DataFrame:
    """Every ordered pair of clusters: one row per cluster goes in, so this stays tiny."""
    a = moments.select(F.col(cluster).alias("cluster_a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "m", "v")])
    b = moments.select(F.col(cluster).alias("cluster_b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "m", "v")])
    return a.join(b, F.col("cluster_a") < F.col("cluster_b"))


def welch_test(df: DataFrame, cluster: str, value: str, p_values: bool = True) -> DataFrame:
    """Unequal-variance t-test between all cluster pairs, missing values left out."""
    pairs = _cluster_pairs(_group_moments(df, cluster, value), cluster)
    sa, sb = F.try_divide(F.col("v_a"), F.col("n_a")), F.try_divide(F.col("v_b"), F.col("n_b"))
    t = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(sa + sb))
    dof = F.try_divide(
        F.pow(sa + sb, F.lit(2)),
        F.try_divide(sa * sa, F.col("n_a") - 1) + F.try_divide(sb * sb, F.col("n_b") - 1),
    )
    out = pairs.select("cluster_a", "cluster_b", t.alias("t"), dof.alias("dof"))
    return out.withColumn("p", t_p_value("t", "dof")) if p_values else out


def cohen_d(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Effect size with the pooled standard deviation."""
    pairs = _cluster_pairs(_group_moments(df, cluster, value), cluster)
    pooled = F.try_divide(
        (F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b"), F.col("n_a") + F.col("n_b") - 2
    )
    d = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(pooled))
    return pairs.select("cluster_a", "cluster_b", d.alias("d"))


def compare_clusters(df: DataFrame, cluster: str, value: str, key: str = "num_id") -> DataFrame:
    """Mean, standard error and number of subjects per cluster."""
    rows = df.filter(F.col(value).isNotNull() & F.col(cluster).isNotNull())
    return rows.groupBy(cluster).agg(
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
        F.count_distinct(key).alias("subjects"),
    )


def kruskal_wallis(df: DataFrame, cluster: str, cols: list[str], p_values: bool = True) -> DataFrame:
    """H statistic per feature with tie correction; constant features are skipped.

    Works on one row per (feature, value): mid-ranks come from running counts, so no feature is
    sorted in a single task.
    """
    long = unpivot(df.filter(F.col(cluster).isNotNull()), [cluster], cols)
    cells = value_counts(long, ["variable", cluster], "value", {"cnt": F.count(F.lit(1))})
    ties = cells.groupBy("variable", "value").agg(F.sum("cnt").alias("t"))
    ranked = running_totals(ties, ["variable"], "value", ["t"])
    ranked = ranked.withColumn("midrank", F.col("before_t") + (F.col("t") + 1) / 2)
    per_feature = ranked.groupBy("variable").agg(
        F.sum("t").cast("double").alias("n"),
        F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("tie"),
        F.count(F.lit(1)).alias("distinct"),
    )
    sums = (
        cells.join(ranked.select("variable", "value", "midrank"), ["variable", "value"])
        .groupBy("variable", cluster)
        .agg(F.sum("cnt").alias("nc"), F.sum(F.col("cnt") * F.col("midrank")).alias("rc"))
        .groupBy("variable")
        .agg(F.sum(F.col("rc") * F.col("rc") / F.col("nc")).alias("s"), F.count(F.lit(1)).alias("groups"))
    )
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("tie") / (n * n * n - n))
    out = (
        sums.join(per_feature.filter("distinct > 1"), "variable")
        .select("variable", h.alias("h"), (F.col("groups") - 1).alias("dof"))
    )
    return out.withColumn("p", F.round(chi2_p_value("h", F.col("dof").cast("double")), 6)) if p_values else out


def ks_two_sample(df: DataFrame, source: str, value: str, first, keys: list[str] = (), p_values: bool = True) -> DataFrame:
    """Largest gap between the two empirical distribution functions (`source == first` or not)."""
    hit = F.col(source) == first
    counts = value_counts(
        df, list(keys), value,
        {"c1": F.count_if(hit), "c2": F.count_if(~hit)},
    )
    ranked = running_totals(counts, list(keys), value, ["c1", "c2"])
    sizes = counts.groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    if keys:
        rows = ranked.join(sizes, list(keys))
    else:
        size = sizes.select(F.struct("n1", "n2").alias("s")).scalar()
        rows = ranked.withColumn("_s", size).withColumns({"n1": F.col("_s.n1"), "n2": F.col("_s.n2")})
    gap = F.abs(
        F.try_divide(F.col("before_c1") + F.col("c1"), F.col("n1"))
        - F.try_divide(F.col("before_c2") + F.col("c2"), F.col("n2"))
    )
    out = rows.groupBy(*keys).agg(F.max(gap).alias("d"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    if not p_values:
        return out
    return out.withColumn("p", ks_p_value("d", F.col("n1").cast("double"), F.col("n2").cast("double")))


# -------------------------------------------------------- prediction metrics


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    y, p = F.col(actual), F.col(predicted)
    sse = F.sum((y - p) * (y - p))
    n = F.count(y - p)
    both = df.filter(y.isNotNull() & p.isNotNull())
    return both.groupBy(*keys).agg(
        n.alias("n"),
        (1 - F.try_divide(sse, F.var_pop(y) * n)).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.try_divide(sse, n).alias("mse"),
        F.sqrt(F.try_divide(sse, n)).alias("rmse"),
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str, positive=1) -> DataFrame:
    """Accuracy, confusion counts and F1 of one class."""
    y, p = F.col(actual) == positive, F.col(predicted) == positive
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(actual) == F.col(predicted)).cast("int")).alias("accuracy"),
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    return counted.withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def auc(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """Area under the ROC curve as a rank statistic; ties count half."""
    hit = F.col(actual) == positive
    counts = value_counts(df, [], score, {"pos": F.count_if(hit), "neg": F.count_if(~hit)})
    ranked = running_totals(counts, [], score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
