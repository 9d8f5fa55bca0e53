"""Duplicates of inventories that grow."""
