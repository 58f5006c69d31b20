"""Streaming of the timed-text library."""
