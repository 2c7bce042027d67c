"""Operators of the media analytics library."""
