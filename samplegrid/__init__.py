"""Raster, signal and symbol analytics as DataFrame operators."""
