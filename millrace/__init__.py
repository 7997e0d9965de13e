"""Log-to-metric analytics as DataFrame operators for batch and streaming."""
