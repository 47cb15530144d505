"""Composite plans: routing, narration and the query catalog."""
