"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from reelsieve.plans import core_queries, drift_queries, evaluate_queries, frame_queries, nested_queries, record_queries, scene_queries, stream_queries, vector_queries

MODULES = (core_queries, nested_queries, drift_queries, frame_queries, vector_queries, scene_queries, evaluate_queries, record_queries, stream_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
FLAGSHIP = "e19_select_frames"
