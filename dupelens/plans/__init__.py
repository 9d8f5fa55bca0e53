"""Checked plans of actions, journals, reports, and the catalogue of queries."""
