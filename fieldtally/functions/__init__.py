"""Functions of the campaign analytics library."""
