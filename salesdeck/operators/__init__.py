"""Reusable plan fragments."""
