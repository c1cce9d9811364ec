"""Comparison of two sides in three modes."""
