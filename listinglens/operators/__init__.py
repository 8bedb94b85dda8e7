"""Operators of listinglens."""
