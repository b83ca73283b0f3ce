"""Every operator run on the given tables, each with its SQL oracle where one exists."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import (aggregates, draws, emissions, hierarchy, joins, probability,  # noqa: F401
               projections, sources, validation, windows)

__all__ = ["ORACLES", "QUERIES"]
