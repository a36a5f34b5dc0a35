"""Change detection and continuous refresh with Structured Streaming."""
