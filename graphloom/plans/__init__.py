"""Registered queries of the engine's own operators, with the SQL they are held against."""

from .registry import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
