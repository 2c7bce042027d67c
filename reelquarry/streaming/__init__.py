"""Streaming of the media analytics library."""
