"""All named queries."""

from __future__ import annotations

from scriptorium.plans import annotations, encodings, scans, segments, streams, translation

MODULES = {
    "scans": scans.query,
    "encodings": encodings.query,
    "segments": segments.query,
    "translation": translation.query,
    "annotations": annotations.query,
    "streams": streams.query,
}
QUERIES = {name: fn for module in MODULES.values() for name, fn in module.queries.items()}
ORACLES = {name: sql for module in MODULES.values() for name, sql in module.oracles.items()}
