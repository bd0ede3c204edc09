"""op9: the main text of all pages."""

from . import style_tree
from .common import table
from .registry import query


@query("op9_site_style_tree")
def op9_site_style_tree(spark, folder):
    return style_tree.extract(table(spark, folder, "pages"))
