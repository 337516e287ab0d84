"""Feedback analytics on Spark: conversations, labels, search, statistics and rankings as DataFrame jobs."""
