"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from . import estimation, priors, raking, routing, statistics, tables  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
