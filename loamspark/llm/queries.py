"""All queries of this subpackage, with the SQL that states the same result."""

from __future__ import annotations

from loamspark.llm import queries_corpus, queries_models, queries_records, queries_shop

QUERIES = {**queries_records.QUERIES, **queries_corpus.QUERIES, **queries_models.QUERIES, **queries_shop.QUERIES}
ORACLE_SQL = {**queries_records.ORACLE_SQL, **queries_corpus.ORACLE_SQL}
