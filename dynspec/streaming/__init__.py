"""Streams of samples and events."""
