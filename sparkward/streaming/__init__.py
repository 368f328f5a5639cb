"""Prompt risk and findings as streams."""
