"""Structured Streaming forms of the rollup (S1), detection (S2), linkage (S3) and decision sink."""
