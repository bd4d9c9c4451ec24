"""Fixture views, registered queries with their SQL, and multi-operator pipelines."""
