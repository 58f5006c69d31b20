"""Plans of the timed-text library."""
