"""Lectern: a Spark-first document-graph analytics engine."""
