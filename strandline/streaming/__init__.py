"""Streaming forms of the periodic passes."""
