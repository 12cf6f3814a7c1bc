"""All queries of the library, by name."""

from __future__ import annotations

from mediasift.plans import alignment, general, maintenance, matching, records, streams

MODULES = (matching, alignment, records, maintenance, streams, general)
FLAGSHIP = "temporal_match"
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
