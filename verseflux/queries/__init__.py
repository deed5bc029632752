"""Registered queries on the test tables, each next to its SQL for comparison."""

from verseflux.queries import correlation, joins, models, sentiment, signals, texts
from verseflux.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "correlation", "joins", "models", "sentiment", "signals", "texts"]
