"""Spark-native building, auditing and repair of knowledge hypergraphs taken from text."""
