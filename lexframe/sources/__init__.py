"""Readers and parsers of landed files, and the Parquet sink."""
