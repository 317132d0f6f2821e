"""The queries of this subpackage, one for each operator, and their SQL where there is one."""

from __future__ import annotations

from lignum.llm import ann, bpe, chat, html_text, importance, language, licenses, mixing, near_vectors, ngram_join, pitman_yor, prefix_trie, warc

MODULES = (warc, language, html_text, mixing, near_vectors, ann, ngram_join, pitman_yor, bpe, licenses, prefix_trie, importance, chat)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
