"""Duplicate and similarity analytics over large inventories, on PySpark."""
