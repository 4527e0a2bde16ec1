"""Structured Streaming jobs, each beside a batch form with the same results."""
