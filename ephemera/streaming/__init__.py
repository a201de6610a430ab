"""Streams of events enriched with sky state."""
