"""Composite plans: the tools."""
