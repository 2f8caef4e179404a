"""Registered queries and their reference SQL."""
from . import metrics_queries, model_queries, prep_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
