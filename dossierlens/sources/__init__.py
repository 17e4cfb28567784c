"""Sources and sinks: delimited dumps, document folders, stored tables, result files."""

from .delimited import read_delimited
from .documents import read_case_documents
from .results import read_weights, write_context, write_weights
from .stored import is_complete, materialize, scratch_path
from .wiki import read_wiki_pages

__all__ = [
    "is_complete",
    "materialize",
    "read_case_documents",
    "read_delimited",
    "read_weights",
    "read_wiki_pages",
    "scratch_path",
    "write_context",
    "write_weights",
]
