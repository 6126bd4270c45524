"""Tallyloom plans."""
