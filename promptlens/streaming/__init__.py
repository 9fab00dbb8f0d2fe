"""The same transforms as Structured Streaming queries."""
