"""All registered queries by name, and their SQL for the oracle."""

from chronolake.plans import lake_rows, logs, objects, oracle, queries, requests, similar

QUERIES = queries.QUERIES | lake_rows.QUERIES | logs.QUERIES | objects.QUERIES | requests.QUERIES | similar.QUERIES
ORACLE = oracle.ORACLE | lake_rows.ORACLE | logs.ORACLE | objects.ORACLE | requests.ORACLE | similar.ORACLE
