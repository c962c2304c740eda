"""Scans and sinks: request bodies, topics, span and state tables, reports, fabricated data."""
