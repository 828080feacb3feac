"""All queries of the core, with the SQL they are compared with."""

from __future__ import annotations

from weftline.plans import general, matrix, parts, problems, reviews, scalars, store

QUERIES = {**problems.QUERIES, **store.QUERIES, **scalars.QUERIES, **reviews.QUERIES, **matrix.QUERIES, **general.QUERIES, **parts.QUERIES}
ORACLES = {**problems.ORACLES, **store.ORACLES, **scalars.ORACLES, **reviews.ORACLES, **matrix.ORACLES, **general.ORACLES, **parts.ORACLES}
