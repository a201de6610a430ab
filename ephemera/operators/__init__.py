"""Event tables, feeds and their refresh."""
