"""All registered queries."""

from almanac.queries import foundation, modelling, panel, policies, quality, scored, streams  # noqa: F401
from almanac.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
