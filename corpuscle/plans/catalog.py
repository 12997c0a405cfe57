"""All registered queries."""

from corpuscle.plans import corpus, designs, graphs, offers, predictions, profiles, relations, search, streams  # noqa: F401
from corpuscle.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
