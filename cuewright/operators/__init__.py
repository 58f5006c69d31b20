"""Operators of the timed-text library."""
