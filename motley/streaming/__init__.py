"""Incremental versions of the aggregations over streams."""
