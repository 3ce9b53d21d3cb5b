"""Queries over the given tables, each with the SQL it is checked against where SQL can say it."""

from workload import events, runs, tables
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "events", "runs", "tables"]
