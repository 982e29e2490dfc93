"""Semantic analytics engine on PySpark."""
