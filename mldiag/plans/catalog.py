"""Imports every module that registers queries."""

from mldiag.plans import (  # noqa: F401
    annotate_queries,
    drift_queries,
    embedding_queries,
    explain_queries,
    model_queries,
    profile_queries,
    source_queries,
    state_queries,
    workflow_queries,
)

FLAGSHIP = "drift_scores"
