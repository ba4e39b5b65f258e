"""Readers, writers, caches and extractor backends."""
