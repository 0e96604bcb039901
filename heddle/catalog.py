"""All registered queries over the grouped-sample operators."""

from heddle.plans import audits, conditions, integrity, lengths, models, pooling, ranking, reports, splits, states, tables, tensors
from heddle.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audits", "conditions", "integrity", "lengths", "models", "pooling", "ranking", "reports", "splits", "states", "tables", "tensors"]
