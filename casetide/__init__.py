"""Adverse-event report analytics as PySpark DataFrame operators."""
