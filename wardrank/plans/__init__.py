"""Composed analyses (reports, recommend), the query registry and the SQL oracle."""
