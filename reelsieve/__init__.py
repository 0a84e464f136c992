"""Spark-first engine for ordered media-like sequences: gate, deduplicate, select, evaluate."""

__version__ = "0.1.0"
