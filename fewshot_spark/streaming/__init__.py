"""Structured Streaming entry points (scoring new texts with trained weights)."""
