"""Functions of the media analytics library."""
