"""Structured Streaming forms of panel operators."""
