"""All registered queries and their SQL twins."""

from riskframe.queries import (  # noqa: F401
    evaluation,
    explanation,
    modelling,
    preprocessing,
    projection,
)
from riskframe.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
