"""Sources of the timed-text library."""
