"""Compositions of operators that answer one study question."""
