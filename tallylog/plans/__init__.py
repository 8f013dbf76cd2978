"""Filters as text, and what they become."""
