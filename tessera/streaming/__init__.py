"""Structured Streaming reports."""
