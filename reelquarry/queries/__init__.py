"""Registered queries over the driver tables, by topic."""
