"""Streaming forms of the message operators."""
