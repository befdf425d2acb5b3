"""Structured Streaming: one query per sink, fan-out, and sinks."""
