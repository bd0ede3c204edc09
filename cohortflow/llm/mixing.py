"""Mixing sources to target weights by repetition.

Token totals per source give each source a target share; target / total is its repetition rate. A document is taken
floor(rate) times, and once more with the probability of the remaining fraction, decided by a hash of its id and a seed.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a source without words has
rate 0; rows that repeat an id get the same decision each; an empty table stays empty; all columns of the input are kept
and helper names never clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import fresh, word_count

WEIGHTS = (1.0, 2.0, 3.0)
MAX_RATE = 3.0
SEED = "mix"


def hash_uniform(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(sized: DataFrame, weights: tuple = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Sources in order of their name take the weights in turn and share the size of everything. Targets above max_rate
    times their source's size stop there and the rest is shared again by weight: with the sources ordered by cap / weight,
    source k is capped exactly when its cap is at most its share of what the caps before it leave. One row per source
    reaches these windows, already aggregated.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    name_order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(name_order) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("place", F.row_number().over(name_order))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
    )
    open_level = F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(everything)
    share = F.coalesce(F.least(F.col("cap"), F.col("weight") * open_level), F.col("cap"))
    return levels.select(
        "source",
        "source_size",
        share.alias("target"),
        F.when(F.col("source_size") > 0, F.least(F.lit(float(max_rate)), share / F.col("source_size"))).otherwise(0.0).alias("rate"),
    )


def copies(rate: Column, uniform: Column) -> Column:
    return (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("long")).cast("long")


def with_rates(docs: DataFrame, rates: DataFrame, source_col: str = "source") -> DataFrame:
    """docs with source_size, target and rate (names made free); the rates hold one row per source."""
    names = fresh(docs, "source_size", "target", "rate", "_rate_source")
    small = rates.toDF("_rate_key", *names[:3])
    return docs.join(small, docs[source_col].eqNullSafe(small["_rate_key"]), "left").drop("_rate_key"), names


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of docs as many times as it is taken, all columns kept."""
    rates = cut_lineage(source_rates(docs.select("source", word_count().alias("size")), weights, max_rate))
    rated, names = with_rates(docs, rates)
    (times,) = fresh(rated, "times")
    taken = rated.withColumn(times, copies(F.coalesce(F.col(names[2]), F.lit(0.0)), hash_uniform("doc_id", seed)))
    (copy,) = fresh(taken, "copy")
    repeated = taken.filter(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_report(docs: DataFrame, weights: tuple = WEIGHTS, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of docs."""
    sized = cut_lineage(docs.select("doc_id", "source", word_count().alias("size")))
    rated, _ = with_rates(sized, source_rates(sized, weights, max_rate))
    return rated.withColumn("copies", copies(F.col("rate"), hash_uniform("doc_id", seed))).withColumn("taken", F.col("copies") * F.col("size"))
