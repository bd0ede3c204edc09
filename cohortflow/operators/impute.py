"""Held-out masking and iterative random-forest imputation."""

from __future__ import annotations

from collections.abc import Generator, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.small_forest import forests_predict
from ..session import cut_lineage
from .ordering import below_cut, hash_cut, unpivot
from .stats import ks_two_sample
from .timeline import require_panel, spread_subjects

# ------------------------------------------------------------------- masking


def _cell_hash(column, idx: str, seed: int):
    return F.xxhash64(F.col(idx), column, F.lit(seed))


def require_unique(df: DataFrame, idx: str) -> None:
    twice = df.groupBy(idx).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{idx} = {twice[0][0]!r} identifies {twice[0][1]} rows")


def mask_cells(df: DataFrame, cols: list[str], idx: str = "idx", share: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Hide an exact number of observed cells: floor(rows * columns * share).

    The observed cells with the smallest hash are hidden, so the choice is reproducible, without
    replacement and needs no join: a cell only compares its hash with one scalar.
    `idx` must identify a row. Returns the masked table and the hidden cells (idx, variable, value).
    """
    cells = unpivot(df, [idx], cols).filter(F.col("value").isNotNull())
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = hash_cut(cells, _cell_hash(F.col("variable"), idx, seed), [idx, "variable"], F.floor(rows * len(cols) * F.lit(share)))
    marked = df.withColumn("_cut", cut)

    def hidden(c: str):
        me = F.struct(_cell_hash(F.lit(c), idx, seed).alias("_h"), F.col(idx), F.lit(c).alias("variable"))
        return F.coalesce(me <= F.col("_cut"), F.lit(False))

    masked = marked.withColumns({c: F.when(~hidden(c), F.col(c)) for c in cols}).drop("_cut")
    mask = cells.filter(below_cut(_cell_hash(F.col("variable"), idx, seed), [idx, "variable"], cut))
    return masked, mask


def mask_column(df: DataFrame, column: str, idx: str = "idx", share: float = 0.1, seed: int = 42):
    return mask_cells(df, [column], idx, share, seed)


def imputation_error(mask: DataFrame, imputed: DataFrame, idx: str = "idx", p_values: bool = True) -> DataFrame:
    """Scaled RMSE, R2 and KS statistic of imputed against hidden values, as one row.

    `baseline_r2` is the better of the imputation and the plain mean. When a cell was not imputed
    the status says so and the figures are NULL.
    """
    cols = [f.name for f in imputed.schema.fields if f.name != idx and f.dataType.simpleString() in ("double", "float", "int", "bigint")]
    guess = unpivot(imputed, [idx], cols, val="guess")
    return _error_of(mask.join(guess, [idx, "variable"], "left"), p_values)


def _error_of(both: DataFrame, p_values: bool = True) -> DataFrame:
    v, g = F.col("value"), F.col("guess")
    sse = F.sum((v - g) * (v - g))
    n = F.count(F.lit(1))
    r2 = 1 - F.try_divide(sse, F.var_pop("value") * n)
    score = both.agg(
        n.alias("cells"),
        F.count(F.lit(1)).alias("_n"),
        (F.count(F.lit(1)) - F.count("guess")).alias("unfilled"),
        F.try_divide(F.sqrt(sse / n), F.avg("value")).alias("rmse_scaled"),
        r2.alias("r2"),
        F.greatest(r2, F.lit(0.0)).alias("baseline_r2"),
    ).drop("_n")
    samples = both.select(F.lit("original").alias("source"), v.alias("x")).unionByName(both.select(F.lit("imputed").alias("source"), g.alias("x")))
    ks = ks_two_sample(samples, "source", "x", "original", p_values=p_values)
    fields = ["d", "p"] if p_values else ["d"]
    packed = ks.select(F.struct(*fields).alias("k")).scalar()
    out = score.withColumn("_k", packed).withColumn("status", F.when(F.col("unfilled") == 0, "ok").otherwise("unfilled"))
    ok = F.col("status") == "ok"
    return out.select(
        "cells", "status",
        *[F.when(ok, F.col(c)).alias(c) for c in ("rmse_scaled", "r2", "baseline_r2")],
        *[F.when(ok, F.col(f"_k.{f}")).alias(f"ks_{f}") for f in fields],
    )


# --------------------------------------------------------------------- gates


def column_gates(df: DataFrame, cols: list[str], max_missing: float = 0.3) -> DataFrame:
    """Which columns may be imputed one at a time."""
    packed = [F.struct(F.lit(c).alias("variable"), F.avg(F.col(c).isNull().cast("int")).alias("missing")) for c in cols]
    shares = df.agg(F.array(*packed).alias("a")).select(F.inline("a"))
    passes = (F.col("missing") > 0) & (F.col("missing") < max_missing)
    return shares.withColumn("passes", passes.cast("int"))


def subject_gates(df: DataFrame, cols: list[str], key: str = "num_id", min_rows: int = 20, min_observed: float = 0.6) -> DataFrame:
    """Rows and observed share per subject, columns that are empty for the subject left out."""
    seen = [F.when(F.count(c) > 0, F.count(c)).otherwise(0) for c in cols]
    usable = [F.when(F.count(c) > 0, 1).otherwise(0) for c in cols]
    total, width = reduce(lambda a, b: a + b, seen), reduce(lambda a, b: a + b, usable)
    gates = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.try_divide(total, F.count(F.lit(1)) * width).alias("observed")
    )
    passes = (F.col("n_rows") >= min_rows) & (F.coalesce("observed", F.lit(0.0)) >= min_observed)
    return gates.withColumn("passes", passes.cast("int"))


# ------------------------------------------------------------ forest imputer


def _forest_rounds(df: DataFrame, cols: list[str], predictors: list[str], rounds: int, trees: int, depth: int, seed: int) -> DataFrame:
    """Chained random-forest imputation (Stekhoven and Buehlmann 2012).

    Mean start, columns by rising missing share, stop when the change between rounds grows.
    """
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in {*cols, *predictors}], *[F.avg(F.col(c).isNull().cast("int")).alias(f"s_{c}") for c in cols]
    ).first()
    todo = sorted((c for c in cols if 0 < stats[f"s_{c}"] < 1), key=lambda c: (stats[f"s_{c}"], c))
    flags = {f"_na_{c}": F.col(c).isNull() for c in todo}
    filled = df.withColumns(flags).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(float(stats[f"m_{c}"]))) for c in {*cols, *predictors} if stats[f"m_{c}"] is not None}
    )
    current, last = cut_lineage(filled), None
    for r in range(rounds):
        # previous values travel in the same row, so measuring the change needs no join
        new = current.withColumns({f"_old_{c}": F.col(c) for c in todo})
        for c in todo:
            inputs = [p for p in predictors if p != c and stats[f"m_{p}"] is not None]
            ready = VectorAssembler(inputCols=inputs, outputCol="_x").transform(new)
            forest = RandomForestRegressor(
                featuresCol="_x", labelCol=c, predictionCol="_guess", numTrees=trees, maxDepth=depth, seed=seed + r
            ).fit(ready.filter(~F.col(f"_na_{c}")))
            guess = F.when(F.col(f"_na_{c}"), F.col("_guess")).otherwise(F.col(c))
            new = forest.transform(ready).withColumn(c, guess).drop("_x", "_guess")
        new = cut_lineage(new)
        moved = [F.sum(F.when(F.col(f"_na_{c}"), F.pow(F.col(c) - F.col(f"_old_{c}"), F.lit(2)))) for c in todo]
        size = [F.sum(F.when(F.col(f"_na_{c}"), F.col(c) * F.col(c))) for c in todo]
        total = lambda parts: reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
        change = new.agg(F.try_divide(total(moved), total(size)).alias("c")).first()["c"] if todo else None
        if last is not None and change is not None and change > last:
            break
        current, last = new.drop(*[f"_old_{c}" for c in todo]), change
        if not change:
            break
    return current.drop(*flags)


def _trial(df: DataFrame, cols: list[str], predictors: list[str], idx: str, share: float, rounds: int, trees: int, depth: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(df's rows with a column `_i_` of known or imputed values for each of cols, error row) of a run with hidden cells.

    Truth and guess of a cell stay in one row, so nothing is joined; a row without a key keeps its gaps.
    """
    used = sorted({*cols, *predictors})
    masked, _ = mask_cells(df.withColumns({f"_t_{c}": F.col(c) for c in used}), cols, idx, share, seed)
    masked = masked.withColumns({f"_h_{c}": F.col(c).isNull() & F.col(f"_t_{c}").isNotNull() for c in cols})
    filled = _forest_rounds(masked, cols, predictors, rounds, trees, depth, seed)
    known = F.col(idx).isNotNull()
    cells = [F.struct(F.col(f"_h_{c}").alias("hidden"), F.col(f"_t_{c}").cast("double").alias("value"), F.when(known, F.col(c)).alias("guess")) for c in cols]
    both = filled.select(F.inline(F.array(*cells))).filter("hidden").select("value", "guess")
    done = {f"_i_{c}": F.coalesce(F.col(f"_t_{c}").cast("double"), F.when(known, F.col(c))) for c in cols}
    kept = [F.col(f"_t_{c}").alias(c) if c in used else F.col(c) for c in df.columns]
    return filled.withColumns(done).select(*kept, *done), _error_of(both)


def _taken(rows: DataFrame, columns: list[str], cols: list[str], idx: str) -> DataFrame:
    """`columns`, the key first, with the values of `_i_` in place of cols."""
    return rows.select(idx, *[F.col(f"_i_{c}").alias(c) if c in cols else F.col(c) for c in columns if c != idx])


def forest_impute(
    df: DataFrame, cols: list[str], idx: str = "idx", min_observed: float = 0.6, min_r2: float = 0.8, share: float = 0.1,
    rounds: int = 5, trees: int = 20, depth: int = 8, seed: int = 42, legacy_accept: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Impute if a masked trial run is good enough; returns the table and one status row.

    Observed values are never replaced. Empty and complete columns are left alone. `idx` must identify a row: a value
    that two rows share is an error, for rows are joined by it.
    """
    spark = df.sparkSession
    require_unique(df, idx)
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in cols]).first()
    usable = [c for c in cols if 0 < counts[c] < counts["n"]]

    def status(name, r2=None, p=None, rmse=None):
        return spark.createDataFrame(
            [(name, r2, p, rmse, usable if name == "imputed" else [])],
            "status string, r2 double, ks_p double, rmse_scaled double, imputed_columns array<string>",
        )

    if not usable:
        return df, status("nothing to impute")
    if sum(counts[c] for c in usable) / (counts["n"] * len(usable)) < min_observed:
        return df, status("too sparse")
    filled, scores = _trial(df, usable, usable, idx, share, rounds, trees, depth, seed)
    error = scores.first()
    good = error["r2"] is not None and error["r2"] > min_r2
    if legacy_accept:
        good = good or (error["ks_p"] is not None and error["ks_p"] < 0.05)
    if not good:
        return df, status("rejected", error["r2"], error["ks_p"], error["rmse_scaled"])
    return _taken(filled, df.columns, usable, idx), status("imputed", error["r2"], error["ks_p"], error["rmse_scaled"])


def forest_impute_columns(
    df: DataFrame, cols: list[str], predictors: list[str] | None = None, idx: str = "idx", max_missing: float = 0.3, min_r2: float = 0.8,
    share: float = 0.1, rounds: int = 2, trees: int = 20, depth: int = 8, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """One column at a time, the other columns as predictors; status row per column. `idx` must identify a row."""
    require_unique(df, idx)
    predictors = predictors or cols
    gates = {r["variable"]: r for r in column_gates(df, cols, max_missing).collect()}
    out, report = df, []
    for c in cols:
        if not gates[c]["passes"]:
            report.append((c, "gate", None))
            continue
        filled, scores = _trial(out, [c], predictors, idx, share, rounds, trees, depth, seed)
        error = scores.first()
        if error["baseline_r2"] is None or error["r2"] <= min_r2:
            report.append((c, "rejected", error["r2"]))
            continue
        out = filled
        report.append((c, "imputed", error["r2"]))
    done = [c for c, name, _ in report if name == "imputed"]
    if done:
        out = _taken(out, df.columns, done, idx)
    return out, df.sparkSession.createDataFrame(report, "variable string, status string, r2 double")


def _together(tasks: list[Generator]) -> list:
    """Results of generators that yield forest jobs (x, y, x_new, seed, trees); the jobs of one turn grow together."""
    out, waiting = [None] * len(tasks), {i: None for i in range(len(tasks))}
    while waiting:
        jobs: dict[tuple[int, int], list] = {}
        for i, answer in waiting.items():
            try:
                *job, trees = tasks[i].send(answer)
                jobs.setdefault((job[0].shape[1], trees), []).append((i, job))
            except StopIteration as end:
                out[i] = end.value
        waiting = {}
        for (_, trees), some in jobs.items():
            waiting.update(zip([i for i, _ in some], forests_predict([job for _, job in some], trees)))
    return out


def forest_impute_subjects(
    panel: DataFrame, cols: list[str], key: str = "num_id", time: str = "dt", min_rows: int = 20, min_observed: float = 0.6,
    min_r2: float = 0.8, share: float = 0.1, rounds: int = 3, trees: int = 20, seed: int = 42,
) -> DataFrame:
    """Impute within each subject that passes the gates; adds `imputed` and `impute_r2`.

    Needs a panel (unique subject and date), so a group holds at most one row per calendar day.
    Every row and key is kept.
    """
    require_panel(panel, key, time)
    gates = subject_gates(panel, cols, key, min_rows, min_observed).select(key, "passes")
    rows = panel.withColumns({c: F.col(c).cast("double") for c in cols}).join(gates, key)
    schema = StructType([*[f for f in rows.schema.fields if f.name != "passes"], StructField("imputed", DoubleType()), StructField("impute_r2", DoubleType())])

    def fill(x: np.ndarray, base: int) -> Generator:
        missing = np.isnan(x)
        full = np.where(missing, np.nanmean(x, axis=0), x)
        order = [c for c in np.argsort(missing.sum(axis=0)) if missing[:, c].any()]
        for r in range(rounds):
            for c in order:
                rest = np.delete(full, c, axis=1)
                seen = ~missing[:, c]
                full[~seen, c] = yield rest[seen], x[seen, c], rest[~seen], base + r, trees
        return full

    def one(pdf: pd.DataFrame) -> Generator:
        passes = bool(pdf["passes"].iloc[0])
        pdf = pdf.drop(columns="passes").sort_values(time).assign(imputed=0.0, impute_r2=np.nan)
        use = [c for c in cols if pdf[c].notna().any()]
        if not passes or len(use) < 2 or not pdf[use].isna().any().any():
            return pdf
        x = pdf[use].to_numpy(float)
        base = seed + int(pdf[key].iloc[0]) % 100_003
        rng = np.random.default_rng(base)
        at = np.argwhere(~np.isnan(x))
        hide = at[rng.permutation(len(at))[: max(1, int(x.size * share))]]
        trial = x.copy()
        trial[hide[:, 0], hide[:, 1]] = np.nan
        if np.isnan(trial).all(axis=0).any():
            return pdf
        guess = yield from fill(trial, base)
        truth, guess = x[hide[:, 0], hide[:, 1]], guess[hide[:, 0], hide[:, 1]]
        spread = ((truth - truth.mean()) ** 2).sum()
        r2 = 1 - ((truth - guess) ** 2).sum() / spread if spread else np.nan
        pdf["impute_r2"] = r2
        if r2 > min_r2:
            full = yield from fill(x, base)
            pdf[use] = np.where(np.isnan(x), full, x)
            pdf["imputed"] = 1.0
        return pdf

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # rows of the last subject, which may go on in the next frame
        for frame in frames:
            frame = frame if rest is None or not len(rest) else pd.concat([rest, frame], ignore_index=True)
            last = (frame[key] == frame[key].iloc[-1]).to_numpy().argmax() if len(frame) else 0
            rest, whole = frame.iloc[last:], frame.iloc[:last]
            if len(whole):
                yield pd.concat(_together([one(pdf) for _, pdf in whole.groupby(key, sort=False)]))
        if rest is not None and len(rest):
            yield pd.concat(_together([one(rest)]))

    return spread_subjects(rows, key).sortWithinPartitions(key).mapInPandas(run, schema)
