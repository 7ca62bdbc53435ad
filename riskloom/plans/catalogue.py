"""All queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from riskloom.plans import inventory, problems

QUERIES = problems.QUERIES | inventory.QUERIES
ORACLE_SQL = problems.ORACLE_SQL | inventory.ORACLE_SQL
