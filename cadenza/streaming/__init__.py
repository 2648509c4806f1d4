"""Incremental feedback and state."""
