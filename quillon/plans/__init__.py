"""Quillon plans."""
