"""Queries over the standard tables; importing this package registers all of them."""

from . import changes, comparing, events, histories, papers, retrieval, rules, scans, streams, texts, translation  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
