"""Plans of the media analytics library."""
