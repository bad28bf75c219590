"""All registered queries."""

from rainshed.plans import (  # noqa: F401
    evaluation_queries,
    field_queries,
    function_queries,
    model_queries,
    operation_queries,
    panel_queries,
    source_queries,
    station_queries,
)
from rainshed.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
