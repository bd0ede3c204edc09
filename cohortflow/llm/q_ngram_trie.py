"""op1: language-model scores of all documents."""

from . import ngram_trie
from .common import table
from .registry import query


@query("op1_ngram_trie")
def op1_ngram_trie(spark, folder):
    return ngram_trie.score_documents(table(spark, folder, "documents"))
