"""The incremental run as Structured Streaming jobs."""
