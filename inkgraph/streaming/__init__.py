"""Structured Streaming: a feed of created, updated and deleted notes."""
