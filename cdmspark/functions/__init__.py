"""Reusable column expressions (ids, bands, labels, text tokens)."""
