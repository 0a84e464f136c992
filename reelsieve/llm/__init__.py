"""Operators for training data: clusters, top N, canonical values, tokens, mixing, shared spans."""
