"""Training-data operators: mixing, joins, classifiers, counts, scans and dedup."""
