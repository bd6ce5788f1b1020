"""Spark-first analytics: keyed tables, map/reduce pipelines, timelines, latency traces."""
