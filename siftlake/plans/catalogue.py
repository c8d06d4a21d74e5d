"""All registered queries: importing the modules fills the registry."""

from siftlake.plans import (  # noqa: F401
    budget_queries,
    coverage_queries,
    finding_queries,
    loop_queries,
    reader_queries,
    recon_queries,
    route_queries,
    scoring_queries,
    stage_queries,
    tree_queries,
)
from siftlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
