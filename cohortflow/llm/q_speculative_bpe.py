"""op12: every document encoded and decoded again."""

from pyspark.sql import functions as F

from . import speculative_bpe
from .common import table
from .registry import query


@query("op12_speculative_bpe")
def op12_speculative_bpe(spark, folder):
    rows = speculative_bpe.round_trip(table(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
