"""The named queries of the core and their oracles, gathered from the modules of this package."""

from __future__ import annotations

from paperloom.plans import composition, language, prose, publishing, relations, series, signatures, stories, text, times

_MODULES = (times, text, stories, series, signatures, prose, relations, language, publishing, composition)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
FLAGSHIP = "q_ranked_stories"
