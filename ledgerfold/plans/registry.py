"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from ledgerfold.plans import problems, service, store

_MODULES = (problems, store, service)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
FLAGSHIP = "kv_final_state"
