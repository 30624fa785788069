"""Operators on notes and their link graph."""
