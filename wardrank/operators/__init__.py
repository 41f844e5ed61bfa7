"""Reusable DataFrame operators: cleaning, grouped metrics, ranking and top-k."""
