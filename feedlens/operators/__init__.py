"""Operators over messages, conversations and posts; each takes DataFrames and returns one."""
