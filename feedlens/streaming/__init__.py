"""Structured Streaming forms of sessions, trends and late-data handling."""
