"""Whole analyses composed from operators: views, reports, heavy queries."""
