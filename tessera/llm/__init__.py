"""Operators for large training corpora: one module for each, and ``entry`` with their queries."""
