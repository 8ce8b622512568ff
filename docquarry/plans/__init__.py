"""Plans of the registered queries."""

from docquarry.plans import documents, engine, lifecycle, more, nodes, parsing, records, retrieval, snapshots
from docquarry.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "documents", "engine", "lifecycle", "more", "nodes", "parsing", "records", "retrieval", "snapshots"]
