"""Relational operators: ranking, quality, grounding, compression, links, resilience."""
