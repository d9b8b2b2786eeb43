"""Structured Streaming jobs: corpus refresh, new-file pickup, running workflow status."""
