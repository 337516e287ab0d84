"""Readers: raw payloads, the driver's tables as feedback and posts, and merge-style writers."""
