"""The registry of queries over the transaction state, and their SQL twins."""

from __future__ import annotations

from . import logs, mutations, reports

_MODULES = (mutations, reports, logs)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
