"""Encoding of event streams."""
