"""The registered queries, with their SQL."""

from convlake.queries import captures, pages, plans, scalars, streams, turns  # noqa: F401
from convlake.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
