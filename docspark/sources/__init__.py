"""File and table sources."""
