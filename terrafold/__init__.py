"""Point, segment, evidence and vocabulary analytics on Spark DataFrames.

The names below are loaded when they are first used.
"""

from __future__ import annotations

import importlib

_PLACES = {
    "run": "run",
    "read_config": "run",
    "register_views": "plans.views",
    "Protocol": "plans.pipeline",
    "adaptive_partition": "operators.geometry",
    "voxel_partition": "operators.geometry",
    "superpoint_geometry": "operators.geometry",
    "knn_edges": "operators.geometry",
    "evidence_stats": "operators.lifting",
    "lift": "operators.lifting",
    "equal_rank": "operators.lifting",
    "assign_labels": "operators.segment",
    "label_propagation": "operators.graph",
    "caption_images": "operators.backends",
    "caption_records": "operators.vocab",
    "term_frequency": "operators.vocab",
    "score_terms": "operators.vocab",
    "verify_terms": "operators.vocab",
    "normalize_term": "functions.text",
    "confusion": "operators.metrics",
    "summary_metrics": "operators.metrics",
}

__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    value = getattr(importlib.import_module(f"{__name__}.{_PLACES[name]}"), name)
    globals()[name] = value
    return value
