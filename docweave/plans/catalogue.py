"""All queries of the library proper, by name."""

from . import queries_evaluation, queries_layout, queries_state  # noqa: F401  they register themselves
from .registry_of_queries import QUERIES, SQL  # noqa: F401
