"""Dairy milk-recording analytics as PySpark DataFrame operators."""
