"""All queries over the driver's tables, with the SQL that expresses each."""

from evidentia.plans import case_queries, more_queries, person_queries, retrieval_queries, rules_queries, state_queries, statute_queries, stream_queries, text_queries

_PARTS = (retrieval_queries, text_queries, rules_queries, state_queries, more_queries, case_queries, person_queries, statute_queries, stream_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
