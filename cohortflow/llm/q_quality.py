"""op7: quality scores, learnt from the rows whose id hash is not 2 modulo 4."""

from pyspark.sql import functions as F

from ..session import cut_lineage
from . import quality
from .common import id_crc, table
from .registry import query


@query("op7_quality_discriminant")
def op7_quality_discriminant(spark, folder):
    rows = cut_lineage(quality.features(table(spark, folder, "documents")))
    model = quality.fit(quality.training_rows(rows, table(spark, folder, "labels"), id_crc() % 4 != 2))
    scored = rows.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), quality.score_vectors(model)("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))
