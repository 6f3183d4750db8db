"""Newly arriving files."""
