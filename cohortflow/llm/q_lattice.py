"""op10: links and components of all embeddings."""

from pyspark.sql import functions as F

from . import lattice
from .common import table
from .registry import query


@query("op10_lattice_neighbours")
def op10_lattice_neighbours(spark, folder):
    found = lattice.near_vectors(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
