"""op8: every document packed into sequences of 2048 tokens."""

from . import packing
from .common import table
from .registry import query


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))
