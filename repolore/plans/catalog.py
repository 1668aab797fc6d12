"""All registered queries."""

from repolore.plans import (  # noqa: F401
    converse_queries,
    corpus_queries,
    derive_queries,
    generate_queries,
    identity_queries,
    lifecycle_queries,
    store_queries,
    stream_queries,
    vector_queries,
    wiki_queries,
)
from repolore.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
