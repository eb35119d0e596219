"""Named queries over the driver tables (see ``registry``)."""

from . import clean_plans, io_plans, knn_plans, ml_plans, review_plans, stream_plans, text_plans  # noqa: F401  (registers queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
