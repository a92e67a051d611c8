"""Keyed event folds, as batch plans and as Structured Streaming."""
