"""Quillon functions."""
