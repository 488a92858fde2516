"""Structured Streaming forms of timeline operators."""
