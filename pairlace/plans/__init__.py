"""Whole analyses composed from operators, and the registered queries."""
