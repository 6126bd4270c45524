"""Tallyloom functions."""
