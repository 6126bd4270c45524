"""Tallyloom sources."""
