"""Streaming forms of incremental work."""
