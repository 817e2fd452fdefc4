"""Sources of the campaign analytics library."""
