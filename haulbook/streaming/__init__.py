"""Structured Streaming versions of the folds, the sweep and the transfer stages."""
