"""Operators for preparing training data: ten components and a corpus pipeline, all as DataFrame functions."""
