"""Structured Streaming jobs and idempotent micro-batch sinks."""
