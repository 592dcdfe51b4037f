"""Quillon streaming."""
