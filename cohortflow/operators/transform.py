"""Scaling, power transforms, covariate adjustment and principal components."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """z-scores with the population deviation; a constant column is only centred."""
    moments = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).alias("z")
    ).scalar()
    out = df.withColumn("_z", moments)
    scaled = {
        c: (F.col(c) - F.col(f"_z.{c}.m")) / F.when(F.col(f"_z.{c}.s") > 0, F.col(f"_z.{c}.s")).otherwise(1.0)
        for c in cols
    }
    return out.withColumns(scaled).drop("_z")


def log1p_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """log(1 + x), leaving alone any column that holds a negative value."""
    lows = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    safe = [c for c in cols if lows[c] is not None and lows[c] >= 0]
    return df.withColumns({c: F.log1p(c) for c in safe}) if safe else df


def boxcox_expr(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(float(lam))) - 1) / float(lam)


def boxcox(df: DataFrame, cols: list[str], rounds: int = 5, grid: int = 21) -> tuple[DataFrame, dict[str, float]]:
    """Box-Cox with the maximum-likelihood exponent of each column.

    Every round evaluates a grid of exponents for all columns in one aggregation, then zooms in; a column whose best exponent
    is at the edge of its grid gets the next grid there, as wide. A column with values of zero or less is shifted to start
    at 1e-6.
    """
    lows = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    shift = {c: 1e-6 - lows[c] if lows[c] is not None and lows[c] <= 0 else 0.0 for c in cols}
    x = {c: F.col(c) + shift[c] if shift[c] else F.col(c) for c in cols}
    center, half = {c: 0.0 for c in cols}, {c: 4.0 for c in cols}
    left = {c: rounds for c in cols}
    while any(left.values()):
        trial = {c: np.linspace(center[c] - half[c], center[c] + half[c], grid) for c in cols}
        aggs = []
        for c in cols:
            aggs += [F.count(c).alias(f"n_{c}"), F.sum(F.log(x[c])).alias(f"l_{c}")]
            aggs += [F.var_pop(boxcox_expr(x[c], lam)).alias(f"v{i}_{c}") for i, lam in enumerate(trial[c])]
        row = df.agg(*aggs).first()
        for c in cols:
            scores = [
                (lam - 1) * row[f"l_{c}"] - row[f"n_{c}"] / 2 * np.log(row[f"v{i}_{c}"]) if row[f"v{i}_{c}"] and np.isfinite(row[f"v{i}_{c}"]) else -np.inf
                for i, lam in enumerate(trial[c])
            ]
            best = int(np.argmax(scores))
            center[c] = float(trial[c][best])
            if left[c] == rounds and best in (0, grid - 1) and np.isfinite(scores[best]) and abs(center[c]) < 64:
                continue  # the optimum may lie further out
            if left[c]:
                left[c] -= 1
                half[c] *= 2.0 / (grid - 1) * 1.5
    return df.withColumns({c: boxcox_expr(x[c], center[c]) for c in cols}), center


def regress_out(df: DataFrame, covariates: list[str], targets: list[str] | None = None, ignore: list[str] = ()) -> DataFrame:
    """Replace targets by residuals of a least-squares fit on the covariates (with intercept).

    One aggregation yields the means and covariances of all targets; only those sums, whose number
    depends on the variables, reach the driver. Each target uses its own complete rows.
    """
    if targets is None:
        targets = [c for c in df.columns if c not in covariates and c not in ignore]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in covariates])
    aggs = []
    for t in targets:
        ok = complete & F.col(t).isNotNull()
        pick = {c: F.when(ok, F.col(c)) for c in [*covariates, t]}
        aggs += [F.avg(pick[c]).alias(f"m|{t}|{c}") for c in pick]
        names = [*covariates, t]
        aggs += [
            F.covar_pop(pick[a], pick[b]).alias(f"c|{t}|{a}|{b}") for i, a in enumerate(covariates) for b in names[i:]
        ]
    row = df.agg(*aggs).first()
    residual = {}
    for t in targets:
        if row[f"m|{t}|{t}"] is None:
            continue
        p = len(covariates)
        sxx = np.empty((p, p))
        for i, a in enumerate(covariates):
            for j in range(i, p):
                sxx[i, j] = sxx[j, i] = row[f"c|{t}|{a}|{covariates[j]}"]
        sxy = np.array([row[f"c|{t}|{a}|{t}"] for a in covariates])
        beta = np.linalg.lstsq(sxx, sxy, rcond=None)[0]
        fitted = F.lit(float(row[f"m|{t}|{t}"]))
        for a, b in zip(covariates, beta):
            fitted = fitted + (F.col(a) - float(row[f"m|{t}|{a}"])) * float(b)
        residual[t] = F.col(t) - fitted
    return df.withColumns(residual)


def _signs(vectors: np.ndarray) -> np.ndarray:
    """+-1 per component, so that its largest loading becomes positive."""
    top = np.argmax(np.abs(vectors), axis=0)
    return np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def pca_on_clusters(
    df: DataFrame, clusters: dict[str, int], n_components: int = 1, names: dict[int, str] | None = None
) -> tuple[DataFrame, dict[int, dict]]:
    """Leading components of every variable cluster as new columns next to the keys.

    One aggregation gives all within-cluster covariances; eigenvectors of those small matrices are
    found on the driver and the scores are plain column expressions, so rows are never re-joined.
    """
    names = names or {}
    members: dict[int, list[str]] = {}
    for c in df.columns:
        if c in clusters:
            members.setdefault(clusters[c], []).append(c)
    rows = df.na.drop("any")
    aggs = [F.avg(c).alias(f"m|{c}") for cs in members.values() for c in cs]
    aggs += [
        F.covar_samp(a, b).alias(f"c|{a}|{b}") for cs in members.values() for i, a in enumerate(cs) for b in cs[i:]
    ]
    row = rows.agg(*aggs).first()
    info, scores = {}, {}
    for cluster, cs in sorted(members.items()):
        cov = np.array([[row[f"c|{a}|{b}"] if i <= j else row[f"c|{b}|{a}"] for j, b in enumerate(cs)] for i, a in enumerate(cs)])
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][:n_components]
        loadings = vectors[:, order] * _signs(vectors[:, order])
        total = float(values.sum())
        info[cluster] = {
            "columns": cs,
            "explained_variance": [float(v / total) if total else None for v in values[order]],
            "loadings": loadings.tolist(),
        }
        for k in range(loadings.shape[1]):
            parts = [(F.col(c) - float(row[f"m|{c}"])) * float(w) for c, w in zip(cs, loadings[:, k])]
            default = f"c{cluster}_PC{k + 1}"
            scores[names.get(cluster, default) if k == 0 else default] = reduce(lambda a, b: a + b, parts)
    return rows.withColumns(scores), info


def principal_components(df: DataFrame, cols: list[str], k: int = 2, prefix: str = "PC") -> tuple[DataFrame, dict]:
    """Centred component scores of scalar columns."""
    scored, info = pca_on_clusters(df.select(*df.columns), {c: 0 for c in cols}, k)
    return scored.withColumnsRenamed({f"c0_PC{i + 1}": f"{prefix}{i + 1}" for i in range(k)}), info[0]


def vector_components(df: DataFrame, vector: str, k: int = 2, out: str = "scores") -> tuple[DataFrame, list[float]]:
    """Centred component scores of an array column, as an array column."""
    rows = df.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_s").fit(rows)
    mean = rows.agg(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    raw = model.pc.toArray()
    flip = _signs(raw)
    offset = mean @ raw
    # the fitted transform does not centre: subtract the projected mean
    scores = F.array(
        *[(F.get(vector_to_array("_s"), F.lit(i)) - float(offset[i])) * float(flip[i]) for i in range(k)]
    )
    return model.transform(rows).withColumn(out, scores).drop("_v", "_s"), [float(v) for v in model.explainedVariance]
