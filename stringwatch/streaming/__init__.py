"""Structured Streaming versions of the detectors."""
