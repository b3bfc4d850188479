"""Registered queries with their SQL counterparts."""

from weftline.checks import clean, compose, emissions, features, model, profile, sources, split, streaming  # noqa: F401
from weftline.checks.registry import REGISTRY

__all__ = ["REGISTRY"]
