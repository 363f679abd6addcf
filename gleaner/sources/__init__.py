"""Landed inputs and small reference tables, and the retrieval of a corpus."""
