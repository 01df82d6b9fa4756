"""Query bindings over the driver tables; importing registers every query."""

from choicespark.plans import alternatives, cleaning, corpus, evaluation, io, links, models, samples, stream  # noqa: F401
from choicespark.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
