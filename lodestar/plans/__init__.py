"""The catalogue: importing it registers every query."""

from lodestar.plans import bibliography, catalog, changes, records, research, retrieval, runs, scopes, vault, workspace
from lodestar.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "bibliography", "catalog", "changes", "records", "research", "retrieval", "runs", "scopes", "vault", "workspace"]
