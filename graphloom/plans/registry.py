"""Queries and oracles of the graph engine, by key."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
