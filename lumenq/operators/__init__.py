"""Statements that change tables and the catalog."""
