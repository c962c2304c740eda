"""Composed jobs: ingest, tail cycle, persistence, and the registered queries."""
