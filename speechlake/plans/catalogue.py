"""QUERIES and ORACLE_SQL: every query of the library outside llm, with the SQL that gives the same rows."""

from __future__ import annotations

from ..operators import queries
from ..sources import dialogues
from ..streaming import consumer, ledger

QUERIES = queries.QUERIES | consumer.QUERIES | ledger.QUERIES | dialogues.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | consumer.ORACLE_SQL | ledger.ORACLE_SQL | dialogues.ORACLE_SQL
