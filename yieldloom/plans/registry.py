"""All registered queries of the core, by name, and their SQL."""

from __future__ import annotations

from yieldloom.plans import analytics, general, relational, stores, texts

_MODULES = [general, relational, analytics, texts, stores]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
FLAGSHIP = "root_causes"
