"""Event log and incremental fan-out by Structured Streaming."""
