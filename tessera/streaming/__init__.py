"""Structured Streaming: sessions, first-seen gates and lane merging."""
