"""Structured Streaming: incremental, exactly-once load of CSV drops.

The analyses themselves are batch (the inputs are periodic snapshots); the
stream only keeps the stored tables current as new files land.
"""
