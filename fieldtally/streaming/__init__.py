"""Streaming of the campaign analytics library."""
