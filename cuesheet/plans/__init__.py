"""Composed plans and the registry of runnable queries."""

from cuesheet.plans import captions, decks, frames, gating, matching, runs, texts  # noqa: F401
from cuesheet.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
