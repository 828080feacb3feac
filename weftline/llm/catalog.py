"""The queries of this subpackage."""

from __future__ import annotations

from weftline.llm import languages, leaks, matches, packing, variants

QUERIES = {**matches.QUERIES, **variants.QUERIES, **leaks.QUERIES, **languages.QUERIES, **packing.QUERIES}
ORACLES = {**matches.ORACLES, **variants.ORACLES, **leaks.ORACLES, **languages.ORACLES, **packing.ORACLES}
