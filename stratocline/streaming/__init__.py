"""Streaming aggregates, beyond what the batch engine needs."""
