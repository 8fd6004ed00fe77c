"""Queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from . import chat, decontaminate, gif, html, mixing, simhash, suffix, tokens, toxicity, warc

_MODULES = (decontaminate, suffix, simhash, gif, html, chat, tokens, toxicity, mixing, warc)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
