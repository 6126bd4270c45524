"""Tallyloom operators."""
