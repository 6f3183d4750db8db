"""Ordering, duplicate removal, limits, merging and verification."""
