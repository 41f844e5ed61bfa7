"""Ingest (CSV), storage (Parquet), catalog helpers and the test fixture."""
