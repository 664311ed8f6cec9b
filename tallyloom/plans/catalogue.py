"""Every registered query of the library's own operators, with the SQL that it is compared with."""

from __future__ import annotations

from tallyloom.plans import corpus, evaluation, experiments, forms, logs, protocol, retrieval, storage, streams

_parts = (retrieval, corpus, evaluation, experiments, logs, streams, forms, protocol, storage)

QUERIES = {name: query for part in _parts for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _parts for name, sql in part.ORACLES.items()}
