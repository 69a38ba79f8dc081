"""All registered queries; importing a query module registers its queries."""

from .registry import ORACLES, QUERIES
from . import (
    clean_queries, forecast_queries, ml_queries, question_queries, rollup_queries, rule_queries,
    scenario_queries, source_queries,
)

FLAGSHIP = "fc_champion"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
