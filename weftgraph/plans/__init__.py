"""Whole flows, adapters from tables to graphs, and the catalogue of queries."""
