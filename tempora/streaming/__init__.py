"""Structured Streaming versions of the audit and the window monitor."""
