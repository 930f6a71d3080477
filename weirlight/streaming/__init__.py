"""Scoring of unbounded streams with Structured Streaming."""
