"""Streams of result events."""
