"""Structured Streaming jobs on the feedback feed."""
