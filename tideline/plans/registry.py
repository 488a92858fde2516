"""Every query of the library outside the training-data subpackage, with its DuckDB SQL."""

from __future__ import annotations

from tideline.plans import audits, boundaries, captions, catalog, documents, published, schemas, store, stories, streams

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (stories, captions, audits, catalog, store, documents, boundaries, schemas, published, streams):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
