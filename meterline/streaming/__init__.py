"""Structured Streaming forms of the live totals and the live monitor."""
