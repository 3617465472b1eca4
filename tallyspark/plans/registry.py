"""The registered queries: one for each operator, with the equal SQL where there is one."""

from __future__ import annotations

from tallyspark.plans import lists, more, parse, rows, scalars, stats, streams

_PARTS = (lists.R, stats.R, scalars.R, streams.R, more.R, rows.R, parse.R)
QUERIES = {k: f for part in _PARTS for k, f in part.queries.items()}
ORACLES = {k: s for part in _PARTS for k, s in part.oracles.items()}
FLAGSHIP = "list_page"
