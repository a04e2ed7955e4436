"""Operators composed into complete jobs."""
