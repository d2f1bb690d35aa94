"""Structured Streaming forms of the recurring operators."""
