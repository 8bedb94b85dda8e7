"""Streaming of listinglens."""
