"""The user-level jobs, composed of the operators."""

from .context import (
    category_weights_of_dump,
    document_context,
    document_scores,
    page_similarity,
    run_context,
)

__all__ = [
    "category_weights_of_dump",
    "document_context",
    "document_scores",
    "page_similarity",
    "run_context",
]
