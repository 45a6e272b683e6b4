"""Structured Streaming extensions; the batch operators do not need them."""
