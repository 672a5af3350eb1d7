"""Relational operators, one module per capability family."""
