"""Structured Streaming: payload decode, running aggregates, scoring and query control."""
