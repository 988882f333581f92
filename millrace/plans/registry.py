"""All registered queries over the relational and event tables."""

from . import composed, formats, relational, spread, streams, udfs  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
