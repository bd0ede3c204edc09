"""op6: token ids written to ORC in id order and read back."""

from . import orc_tokens
from .common import table
from .registry import query


@query("op6_orc_tokens")
def op6_orc_tokens(spark, folder):
    path = orc_tokens.write_tokens(table(spark, folder, "documents"), orc_tokens.shared_path(spark, "tokens"))
    return orc_tokens.token_index(spark, path)
