"""Lakehouse data operations as PySpark DataFrame and Column functions."""

__version__ = "0.1.0"
