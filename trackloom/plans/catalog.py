"""Every registered query of the library proper, with its DuckDB twin."""

from __future__ import annotations

from trackloom.plans import queries_alignment, queries_binning, queries_features, queries_images, queries_learning, queries_matching, queries_metrics, queries_scalars, queries_tracks

_PARTS = (queries_alignment, queries_binning, queries_features, queries_images, queries_learning, queries_matching, queries_metrics, queries_scalars, queries_tracks)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
