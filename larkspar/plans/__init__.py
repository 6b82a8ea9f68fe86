"""Queries, bindings and actions."""
