"""All queries by name, and the oracle SQL of those that SQL can express."""

from .plans import q_days, q_lab, q_market, q_recall, q_store, q_stream, q_text

QUERIES: dict = {}
SQL: dict = {}
for _module in (q_recall, q_market, q_text, q_stream, q_lab, q_days, q_store):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
