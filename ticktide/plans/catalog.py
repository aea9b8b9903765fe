"""All queries, loaded."""

from ticktide.plans import (  # noqa: F401
    queries_facts,
    queries_metrics,
    queries_models,
    queries_panel,
    queries_quality,
    queries_serving,
    queries_stream,
    queries_text,
)
from ticktide.plans.registry import ORACLES, QUERIES  # noqa: F401
