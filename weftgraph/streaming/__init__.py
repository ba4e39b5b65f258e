"""Graphs from a stream of facts."""
