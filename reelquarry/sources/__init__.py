"""Sources of the media analytics library."""
