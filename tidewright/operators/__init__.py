"""Operators on observations and rasters."""
