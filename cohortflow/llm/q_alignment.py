"""op11: the tokens of two tokenizers aligned in every document."""

from . import diagonal_alignment
from .common import table
from .registry import query


@query("op11_diagonal_alignment")
def op11_diagonal_alignment(spark, folder):
    return diagonal_alignment.align(table(spark, folder, "documents"))
