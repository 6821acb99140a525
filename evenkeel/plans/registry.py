"""All registered queries and oracles."""

from evenkeel.plans import audit_queries, detect_queries, mitigate_queries, model_queries, rule_queries

QUERIES = {}
ORACLE = {}
for _mod in (audit_queries, detect_queries, mitigate_queries, model_queries, rule_queries):
    QUERIES.update(_mod.QUERIES)
    ORACLE.update(_mod.ORACLE)
