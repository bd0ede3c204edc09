"""op4: SimHash components of all documents."""

from . import simhash_bk
from .common import table
from .registry import query


@query("op4_simhash_bk_trees")
def op4_simhash_bk_trees(spark, folder):
    found = simhash_bk.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash_bk.hex_digits(found["fp"]).alias("fingerprint"), "component_id")
