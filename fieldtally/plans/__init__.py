"""Plans of the campaign analytics library."""
