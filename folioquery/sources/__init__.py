"""Inputs: tables, derived Markdown, file listings."""
