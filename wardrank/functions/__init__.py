"""Column expressions: sentinel-safe casts, exact aggregates, recodes and labels."""
