"""op2: invertible sketches of every document and its edited version."""

from . import iblt
from .common import table
from .registry import query


@query("op2_invertible_sketch")
def op2_invertible_sketch(spark, folder):
    return iblt.version_fingerprints(table(spark, folder, "documents"))
