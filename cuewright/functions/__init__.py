"""Functions of the timed-text library."""
