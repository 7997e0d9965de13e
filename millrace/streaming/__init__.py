"""Streaming forms of the operators and sinks."""
