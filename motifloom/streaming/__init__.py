"""Series built from streams of events."""
