"""Registry of the queries over the library's own operators."""

from __future__ import annotations

from clausewright import queries_facts, queries_learning, queries_segmentation

FLAGSHIP = "segmented_clauses"
QUERIES = {**queries_segmentation.QUERIES, **queries_learning.QUERIES, **queries_facts.QUERIES}
ORACLES = {**queries_segmentation.ORACLES, **queries_learning.ORACLES, **queries_facts.ORACLES}
