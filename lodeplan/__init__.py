"""Governed semantic analytics and data-quality operators for PySpark."""

__version__ = "0.1.0"
