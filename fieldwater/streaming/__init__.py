"""Structured Streaming forms of the metering operators."""
