"""Plans: the derived corpora, and every registered query with the SQL it must agree with."""

from doctree.plans import diff_queries, mark_queries, quality_queries, search_queries, text_queries, tree_queries  # noqa: F401
from doctree.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
