"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from doctree.llm import chat, conversation_repair, decontaminate, language_id, line_dedup, packing, prefix_trie, quality_model, quality_rules, sharding, simhash, substring_dedup, token_counts

MODULES = [chat, quality_rules, sharding, substring_dedup, packing, decontaminate, line_dedup, simhash, quality_model, language_id, token_counts, prefix_trie, conversation_repair]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
