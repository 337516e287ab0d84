"""Driver-side planning: requests, time windows and search intents become column predicates."""
