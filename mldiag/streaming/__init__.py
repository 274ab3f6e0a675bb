"""Streaming counterparts of the drift and class counters."""
