"""Configuration and views."""
