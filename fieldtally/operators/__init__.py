"""Operators of the campaign analytics library."""
