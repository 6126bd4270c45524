"""Tallyloom streaming."""
