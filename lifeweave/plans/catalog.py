"""All queries outside the optional subpackage, and the SQL that checks them."""

from __future__ import annotations

from lifeweave.plans import basics, exports, film, general, library, pairs, selection, streams, tracks

_MODULES = [general, selection, library, tracks, pairs, film, basics, exports, streams]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
flagship = selection.representative_events
